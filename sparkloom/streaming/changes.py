"""The change feed of files: latest state, debounce, and the same as Structured Streaming programs."""

from __future__ import annotations

import uuid
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.session import scratch

#: A row of the feed.
CHANGE = "event_id long, ts timestamp_ntz, path string, change_type string"


def latest(changes: DataFrame) -> DataFrame:
    """(path, ts, change_type, n_changes): the newest change of every path, by time and event."""
    newest = F.max(F.struct("ts", "event_id", "change_type")).alias("m")
    return changes.groupBy("path").agg(newest, F.count(F.lit(1)).alias("n_changes")).select("path", "m.ts", "m.change_type", "n_changes")


def debounced(changes: DataFrame, seconds: float = 2.0) -> DataFrame:
    """(project, first_ts, last_ts, n_changes, n_paths): bursts of a project's changes with no gap longer than that."""
    timed = changes.select(F.split("path", "/")[0].alias("project"), "path", "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    order = W.partitionBy("project").orderBy("us", "event_id")
    new = timed.withColumn("new", (F.col("us") - F.lag("us").over(order) > int(seconds * 1e6)).cast("int"))
    numbered = new.withColumn("burst", F.coalesce(F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    return numbered.groupBy("project", "burst").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_changes"), F.countDistinct("path").alias("n_paths")).drop("burst")


def read_feed(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The feed as a stream of the Parquet files in a folder."""
    return spark.readStream.schema(CHANGE).option("pathGlobFilter", pattern).parquet(folder)


def debounced_stream(changes: DataFrame, seconds: float = 2.0, late: str = "1 minute") -> DataFrame:
    """Session windows of each project's changes; a change later than the watermark is left out."""
    timed = changes.select(F.split("path", "/")[0].alias("project"), "path", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("project", F.session_window("ts", f"{int(seconds * 1000)} milliseconds").alias("w")).agg(F.count(F.lit(1)).alias("n_changes"), F.collect_set("path").alias("paths")).select("project", F.col("w.start").alias("first_ts"), "n_changes", "paths")


def newest_stream(changes: DataFrame) -> DataFrame:
    """(path, ts, change_type, n_changes) of every path that a batch has changes of; what is older than the newest version is only
    counted. A path's state is one row of an aggregate, made without Python, so that many paths of few changes cost little."""
    return latest(changes)


def drain(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Runs a stream over what there is, into a Parquet table of its batches with a `batch` column, and returns that table.

    Progress and state are in the shared folder; a batch that is run again overwrites what it had written.
    """
    spark, base = stream.sparkSession, f"{scratch(stream.sparkSession)}/loom-stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/table/batch={batch}")

    # state on the executors' disks: the default keeps every key in the heap
    provider, conf = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, provider)
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(conf, before) if before else spark.conf.unset(conf)
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/table")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], f"{names}, batch int")
    return spark.read.schema(f"{names}, batch int").parquet(f"{base}/table")
