import math
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text as fn
from sparkloom.operators import lookups, search

ROWS = [("1", "getHTTPServer", "net.getHTTPServer", "opens the server"), ("2", "server_config", "cfg.server_config", None), ("3", "Config", "cfg.Config", "config of a server, server side"), ("4", "other", "x.other", ""), ("5", "serverside", "x.serverside", None)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, "function", n, q, d, f"src/{n}.py", "python", 1) for i, n, q, d in ROWS], "id string, kind string, name string, qualified_name string, docstring string, file_path string, language string, start_line int").cache()


def brute(words, every):
    docs = {i: [re.findall(r"[a-z0-9]+", (t or "").lower().replace("_", " ")) for t in (n, q, d)] for i, n, q, d in ROWS}
    size = {i: sum(map(len, d)) for i, d in docs.items()}
    avg, n_all = sum(size.values()) / len(docs), len(docs)
    out = {}
    tf = {w: {i: sum(t.startswith(w) for c in d for t in c) for i, d in docs.items()} for w in words}
    for i in docs:
        hit = [tf[w][i] > 0 for w in words]
        if all(hit) if every else any(hit):
            out[i] = -sum(max(math.log((n_all - (n := sum(x > 0 for x in tf[w].values())) + 0.5) / (n + 0.5)), 1e-6) * tf[w][i] * 2.2 / (tf[w][i] + 1.2 * (0.25 + 0.75 * size[i] / avg)) for w in words)
    return out


@pytest.mark.parametrize(("words", "every"), [(["server"], True), (["server", "config"], True), (["config", "opens"], False)])
def test_bm25(nodes, words, every):
    got = {r.id: r["rank"] for r in search.bm25(nodes, list(search.COLUMNS), words, every).collect()}
    want = brute(words, every)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_phrases(nodes):
    assert {r.id for r in search.bm25(nodes, list(search.COLUMNS), ["server_con"]).collect()} == {"2"}
    assert {r.id for r in search.bm25(nodes, list(search.COLUMNS), ["server side"]).collect()} == {"3"}
    assert search.bm25(nodes, list(search.COLUMNS), ["..."]).count() == 0


def test_search_falls_back(nodes):
    assert {r.id for r in search.search(nodes, "er").collect()} == {"1", "2", "3", "4", "5"} - {"3"}
    assert search.search(nodes, "config").first().id in {"2", "3"}
    assert {r.id for r in search.search(nodes, "Config", mode="exact").collect()} == {"3"}
    assert search.search(nodes, "server", paths=["other"]).count() == 0
    assert search.search(nodes, "zzz").count() == 0
    assert search.search(nodes, "100%_", mode="substring").count() == 0
    assert {r.id for r in search.fuzzy(nodes, 'kind:function LANG:python path:config "server"').collect()} == {"2", "3"}
    assert search.best_node(nodes, "Config").first().id == "3"


def test_functions(spark):
    one = spark.range(1)
    seg = lambda s: one.select(fn.segments(F.lit(s)).alias("x")).first().x
    assert seg("getHTTPServer_fooBar-bazID2") == ["get", "http", "server", "foo", "bar", "baz", "id2"]
    cand = lambda s: one.select(fn.candidates(F.lit(s)).alias("x")).first().x
    assert cand("How to fetch the user config? fetch x") == ["how", "fetch", "get", "load", "retrieve", "read", "request", "user", "config", "configuration", "settings", "options"]
    q = fn.parse_query('find "two words" kind:Class lang:go path:src/x kind: a"b c"')
    assert (q.text, q.kinds, q.languages, q.paths) == ('find two words kind: a"b c"', ["class"], ["go"], ["src/x"])
    assert re.match(fn.glob_regex("a[!b]?*.py"), "acd/x.py") and not re.match(fn.glob_regex("a[!b]?*.py"), "abd.py")
    path = lambda c: one.select(c.alias("x")).first().x
    assert path(fn.module_of(F.lit("a/b/__init__.py"))) == "a.b" and path(fn.language_of(F.lit("X/y.PY"))) == "python" and path(fn.language_of(F.lit("no"))) is None
    assert path(fn.normal_path(F.lit("a\\b"))) == "a/b" and path(fn.directory(F.lit("x.py"))) == "."
    assert len(fn.SPECIAL_METHODS) == 36 and len(fn.EXTENSIONS) > 50


def test_segments_and_prose(nodes):
    got = {r.name: list(r.matched_words) for r in search.prose(nodes, "load the server settings").collect()}
    assert got["server_config"] == ["server"]
    assert {(r.name, r.word) for r in search.segment_matches(nodes, ["config", "SERVER", "x"]).collect()} == {("getHTTPServer", "server"), ("server_config", "config"), ("Config", "config")}
    assert search.segment_matches(nodes, ["x"]).count() == 0
    assert lookups.edges_by_node(nodes, nodes.sparkSession.createDataFrame([("1", "2", "calls", 1)], "source string, target string, kind string, line int")).where("size(edges) = 0").count() == 4


def test_shown_values(spark):
    from pyspark.sql import functions as F

    from sparkloom.functions import display

    rows = spark.createDataFrame([(0,), (999,), (1000,), (59_940,), (61_000,), (3_600_000,)], "ms long")
    assert [r[0] for r in rows.select(display.duration(F.col("ms"))).collect()] == ["0ms", "999ms", "1.0s", "59.9s", "1m 1s", "60m 0s"]
    words = spark.createDataFrame([("class",), ("query",), ("key",), ("by",), ("file",)], "w string")
    assert [r[0] for r in words.select(display.plural(F.col("w"))).collect()] == ["classes", "queries", "keys", "bys", "files"]
    assert display.styled("x", "bold") == "\x1b[1mx\x1b[0m" and display.styled("x", "red", False) == "x"


@pytest.mark.parametrize("more", [[], [(1, "b c b")]])
def test_postings_are_counted_within_rows(spark, more):
    """Before, every entry was shuffled; rows that share a key are still added up."""
    rows = [(1, "b a B"), (2, ""), (3, None), (4, "é1 x_é1 a"), *more]
    df = spark.createDataFrame(rows, "k long, t string")
    want = {}
    for k, t in rows:
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            want[w, k] = want.get((w, k), 0) + 1
    found = search.postings(df, "k", "t")
    assert sorted(map(tuple, found.collect())) == sorted((w, k, n) for (w, k), n in want.items())
    assert ("Exchange" in found._jdf.queryExecution().executedPlan().toString()) == bool(more)
    index = search.inverted(df, "k", ("t",))
    assert {(r.term, r.k): r.tf for r in index.collect() if r.term} == want and {r.k for r in index.where("term IS NULL").collect()} == {2, 3}
    assert search.index_totals(index, "k").first().n == 4 and index.where("head").count() == 4
