from datetime import datetime, timedelta

from sparkloom.streaming import changes as C

T0 = datetime(2024, 1, 1)


def feed(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), p, k) for i, s, p, k in rows], C.CHANGE)


def test_debounce(spark):
    df = feed(spark, [(1, 0, "a/x", "added"), (2, 1.5, "a/y", "modified"), (3, 3.5, "a/x", "modified"), (4, 6, "a/x", "removed"), (5, 0, "b/z", "added")])
    got = sorted((r.project, r.n_changes, r.n_paths) for r in C.debounced(df, 2).collect())
    assert got == [("a", 1, 1), ("a", 3, 2), ("b", 1, 1)]


def test_state_survives_batches_and_late_changes(spark, tmp_path):
    one, two = [(1, 10, "a/x", "added"), (2, 5, "a/y", "added")], [(3, 7, "a/x", "removed"), (4, 20, "a/y", "modified"), (5, 30, "a/z", "added")]
    for k, rows in enumerate((one, two)):
        feed(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = spark.readStream.schema(C.CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    table = C.drain(C.newest_stream(stream)).collect()
    last = {}
    for r in sorted(table, key=lambda r: r.batch):
        last[r.path] = (r.ts, r.change_type)
    assert last == {"a/x": (T0 + timedelta(seconds=10), "added"), "a/y": (T0 + timedelta(seconds=20), "modified"), "a/z": (T0 + timedelta(seconds=30), "added")}
    batch = {r.path: (r.ts, r.change_type) for r in C.latest(feed(spark, one + two)).collect()}
    assert batch == last


def test_session_windows(spark, tmp_path):
    feed(spark, [(1, 0, "a/x", "added"), (2, 1, "a/y", "added"), (3, 500, "a/x", "added")]).coalesce(1).write.parquet(f"{tmp_path}/feed")
    got = C.drain(C.debounced_stream(C.read_feed(spark, f"{tmp_path}/feed")), "append").collect()
    assert ("a", 2) in {(r.project, r.n_changes) for r in got}


def test_empty_feed(spark, tmp_path):
    feed(spark, []).write.parquet(f"{tmp_path}/feed")
    assert C.drain(C.newest_stream(C.read_feed(spark, f"{tmp_path}/feed"))).count() == 0


def test_newest_state_counts_late_changes_without_python(spark, tmp_path):
    """Before, a batch of older changes alone left n_changes behind, and each path was a call of Python."""
    for rows in ([(1, 10, "a/x", "added")], [(2, 5, "a/x", "removed"), (3, 5, "b/y", "added")]):
        feed(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    stream = C.newest_stream(spark.readStream.schema(C.CHANGE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed"))
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    last = {r.path: (r.ts, r.change_type, r.n_changes) for r in sorted(C.drain(stream).collect(), key=lambda r: r.batch)}
    assert last == {"a/x": (T0 + timedelta(seconds=10), "added", 2), "b/y": (T0 + timedelta(seconds=5), "added", 1)}
