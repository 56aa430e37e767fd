"""Upserts, identity, referential integrity and cascades, as whole-table programs: every function returns new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def upsert(existing: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Rows of both, of each key the one of greatest order; new rows win over existing ones of equal order."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = W.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def update(existing: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows with the non-null values of changes, by key."""
    cols = [c for c in changes.columns if c != key]
    there = changes.select(F.col(key), *(F.col(c).alias(f"_{c}") for c in cols))
    joined = existing.join(there, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in cols else F.col(c) for c in existing.columns))


def edge_identity(edges: DataFrame) -> list[Column]:
    """What makes two edges one: ends, kind, and place, where no place is a place."""
    none = F.lit(-1)
    return [F.col("source"), F.col("target"), F.col("kind"), F.coalesce("line", none), F.coalesce("col", none) if "col" in edges.columns else none]


def distinct_edges(edges: DataFrame) -> DataFrame:
    keys = edge_identity(edges)
    named = edges.select("*", *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
    return named.dropDuplicates([f"_k{i}" for i in range(len(keys))]).select(*edges.columns)


def with_both_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def insert_edges(existing: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    return distinct_edges(existing.unionByName(with_both_ends(new, nodes)))


def delete_files(nodes: DataFrame, edges: DataFrame, refs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables without the files' nodes, the edges at either end of those, and the references from them."""
    gone = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    left = lambda df, col: df.join(gone.withColumnRenamed("id", col), col, "left_anti")
    return left(nodes, "id"), left(left(edges, "source"), "target").select(*edges.columns), left(refs, "from_node_id").select(*refs.columns)


def edges_touching(edges: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges with an end in one of the files, each once."""
    inside = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi").select("id", F.lit(True).alias("_in"))
    marked = edges.join(inside.select(F.col("id").alias("source"), F.col("_in").alias("_a")), "source", "left").join(inside.select(F.col("id").alias("target"), F.col("_in").alias("_b")), "target", "left")
    return marked.where("_a OR _b").select(*edges.columns)


def file_changes(before: DataFrame, after: DataFrame, value: str = "content_hash") -> DataFrame:
    """path, change of every path whose value differs between two file tables: added, removed or modified."""
    a, b = before.select("path", F.col(value).alias("_a"), F.lit(True).alias("_x")), after.select("path", F.col(value).alias("_b"), F.lit(True).alias("_y"))
    change = F.when(F.col("_x").isNull(), "added").when(F.col("_y").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change IS NOT NULL")
