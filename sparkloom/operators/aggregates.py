"""Counts and summaries of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import text as fn


def totals(nodes: DataFrame, edges: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """metric, n: the number of rows of each table."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("metric"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(count(files, "files")).unionByName(count(refs, "refs"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def files_summary(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every file with the number of its nodes and of each kind, as a map."""
    kinds = nodes.groupBy("file_path", "kind").agg(F.count(F.lit(1)).alias("n"))
    per_file = kinds.groupBy(F.col("file_path").alias("path")).agg(F.sum("n").alias("total"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    return files.join(per_file, "path", "left").select("path", "language", F.coalesce("total", F.lit(0)).cast("long").alias("total"), "kinds")


def caller_summary(callers: DataFrame) -> DataFrame:
    """Of pairs (target, caller, caller_name, caller_file): per target the callers, their files, and per file its names."""
    per_file = callers.groupBy("target", "caller_file").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("caller_name")).alias("names"))
    return per_file.groupBy("target").agg(
        F.sum("n").alias("n_callers"),
        F.count(F.lit(1)).alias("n_files"),
        F.sort_array(F.collect_list(F.struct("caller_file", "n", "names"))).alias("files"),
    )


def directories(files: DataFrame, collapse: int = 10) -> DataFrame:
    """Per directory the number of files, the languages, and the files' names unless there are more than collapse."""
    named = files.select(fn.directory(F.col("path")).alias("dir"), fn.base_name(F.col("path")).alias("file"), "language")
    got = named.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sort_array(F.collect_set("language")).alias("languages"), F.sort_array(F.collect_list("file")).alias("names"))
    return got.withColumn("names", F.when(F.col("n_files") <= collapse, F.col("names")))


def unique_files(found: DataFrame, rank: str = "place") -> DataFrame:
    """(file_path, place) of the files of search results, each at the place of its first result, places from 0."""
    first = found.groupBy("file_path").agg(F.min(rank).alias("_first"))
    # over the files of one page of results
    return first.select("file_path", (F.row_number().over(W.orderBy("_first", "file_path")) - 1).alias("place"))
