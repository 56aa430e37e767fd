"""Composed answers: exploration, focal context and task context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import graph, search
from sparkloom.session import stored

MORE = "\n... (cut)"


def explore(nodes: DataFrame, edges: DataFrame, refs: DataFrame, query: str, limit: int = 20, edges_in: DataFrame | None = None, **filters) -> DataFrame:
    """(id, name, score, n_callers, n_callees) of the found symbols."""
    found = stored(search.search(nodes, query, limit, **filters), "found")
    ids = found.select("id")
    got = found.select("id", "name", "score").join(graph.caller_counts(nodes, edges if edges_in is None else edges_in, refs, ids), "id", "left")
    got = got.join(graph.callee_counts(nodes, edges, refs, ids), "id", "left")
    return got.select("id", "name", "score", F.coalesce("n_callers", F.lit(0)).cast("long").alias("n_callers"), F.coalesce("n_callees", F.lit(0)).cast("long").alias("n_callees"))


def focal(nodes: DataFrame, edges: DataFrame, node: str, depth: int = 3) -> DataFrame:
    """(section, id, detail): ancestors, children, incoming and outgoing references, types and imports of one symbol."""
    other = lambda end: "target" if end == "source" else "source"

    def one(section: str, end: str, kinds: tuple[str, ...]) -> DataFrame:
        got = edges.where((F.col(end) == node) & F.col("kind").isin(*kinds))
        return got.select(F.lit(section).alias("section"), F.col(other(end)).alias("id"), F.col("kind").alias("detail"))

    walk = lambda section, way: graph.traverse(edges, node, depth, way, ["contains"]).where("depth > 0").select(F.lit(section).alias("section"), "id", F.col("depth").cast("string").alias("detail"))
    parts = [walk("ancestors", "in"), walk("children", "out"), one("incoming", "target", graph.USES), one("outgoing", "source", graph.USES), one("types", "source", ("extends", "implements", "type_of", "returns")), one("imports", "source", ("imports",))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(nodes.select("id"), "id", "left_semi").select("section", "id", "detail").distinct()


def around(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the roots and their outgoing neighbours; all edges at the roots, each (source, target, kind) once."""
    roots = roots.select("id").distinct()
    out = edges.join(roots.withColumnRenamed("id", "source"), "source", "left_semi")
    back = edges.join(roots.withColumnRenamed("id", "target"), "target", "left_semi")
    found = out.select("source", "target", "kind").unionByName(back.select("source", "target", "kind")).distinct()
    return nodes.join(roots.union(out.select("target")).distinct(), "id", "left_semi"), found


def task(nodes: DataFrame, edges: DataFrame, query: str, roots: int = 5) -> tuple[DataFrame, DataFrame]:
    """What is around the best found symbols."""
    return around(nodes, edges, stored(search.search(nodes, query, roots).select("id"), "roots"))


def stats(nodes: DataFrame, edges: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """metric, n of a context; with its code blocks also their number and the sum of their lengths."""
    count = lambda df, name, what=F.count(F.lit(1)): df.agg(what.alias("n")).select(F.lit(name).alias("metric"), "n")
    got = count(nodes, "nodes").unionByName(count(edges, "edges")).unionByName(count(nodes, "files", F.countDistinct("file_path")))
    if blocks is None:
        return got
    return got.unionByName(count(blocks, "blocks")).unionByName(count(blocks, "code_size", F.coalesce(F.sum(F.length("block")), F.lit(0)).cast("long")))


def code_block(text: Column, start: Column, end: Column, most: int = 2000) -> Column:
    """Lines start to end of a file's text, stripped, cut after `most` characters with a mark."""
    lines = F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(1)))
    block = F.trim(F.array_join(lines, "\n"))
    return F.when(F.length(block) > most, F.concat(F.substring(block, 1, most), F.lit(MORE))).otherwise(block)


def code_blocks(nodes: DataFrame, sources: DataFrame, most_blocks: int = 10, most_chars: int = 2000) -> DataFrame:
    """(id, file_path, block) of the first symbols by file and line, for display: the limit is part of it."""
    chosen = nodes.where("kind <> 'file'").orderBy("file_path", "start_line", "id").limit(most_blocks)
    joined = chosen.join(sources.select(F.col("path").alias("file_path"), "text"), "file_path")
    return joined.select("id", "file_path", code_block(F.col("text"), F.col("start_line"), F.col("end_line"), most_chars).alias("block"))
