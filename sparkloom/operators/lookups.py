"""Point and set look-ups, filters and table joins over nodes, edges and references. Orders are total."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as fn


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes whose id is in the id column of ids."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def by_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path).orderBy("start_line", "id")


def by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind).orderBy("name", "id")


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name).orderBy("file_path", "start_line", "id")


def by_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.where(F.col("name").startswith(prefix)).orderBy("name", "id")


def by_qualified_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("qualified_name") == name)


def edges_of(edges: DataFrame, node: str, end: str = "source", kinds: Sequence[str] | None = None) -> DataFrame:
    """Edges that have the node at one end; end is source for outgoing, target for incoming."""
    found = edges.where(F.col(end) == node)
    return found.where(F.col("kind").isin(*kinds)) if kinds else found


def edge_between(edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    return edges.where((F.col("source") == source) & (F.col("target") == target) & (F.col("kind") == kind))


def edges_by_node(ids: DataFrame, edges: DataFrame, end: str = "source", kinds: Sequence[str] | None = None) -> DataFrame:
    """Every id with an array of its edges, empty where it has none."""
    other = "target" if end == "source" else "source"
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    grouped = edges.groupBy(F.col(end).alias("id")).agg(F.sort_array(F.collect_list(F.struct("kind", other, "line"))).alias("edges"))
    kind = grouped.schema["edges"].dataType
    return ids.select("id").distinct().join(grouped, "id", "left").withColumn("edges", F.coalesce("edges", F.array().cast(kind)))


def nodes_by_file(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """For each path in the path column of paths, its nodes by line."""
    found = nodes.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    return found.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("start_line", "id"))).alias("nodes"))


def refs_where(refs: DataFrame, name: str | None = None, from_node: str | None = None, paths: DataFrame | None = None) -> DataFrame:
    if name is not None:
        refs = refs.where(F.col("reference_name") == name)
    if from_node is not None:
        refs = refs.where(F.col("from_node_id") == from_node)
    return refs if paths is None else refs.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")


def segment_vocabulary(nodes: DataFrame) -> DataFrame:
    """Distinct (segment, name) of all names."""
    return nodes.select(F.explode(fn.segments(F.col("name"))).alias("segment"), "name").distinct()


def matching(
    kinds: Sequence[str] = (), languages: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = (),
    paths: Sequence[str] = (), visibility: str | None = None, ignore_case: bool = False,
) -> Column:
    """One predicate of all search filters, for use before any limit. paths are parts of the path, any of which will do."""
    ok = F.lit(True)
    if kinds:
        ok &= F.col("kind").isin(*kinds)
    if languages:
        ok &= F.col("language").isin(*languages)
    if include:
        ok &= fn.any_glob(F.col("file_path"), list(include), ignore_case)
    if exclude:
        ok &= ~fn.any_glob(F.col("file_path"), list(exclude), ignore_case)
    if paths:
        ok &= reduce(lambda a, b: a | b, (F.lower("file_path").contains(p.lower()) for p in paths))
    if visibility in ("private", "public"):
        ok &= fn.is_private(F.col("name")) if visibility == "private" else ~fn.is_private(F.col("name"))
    return ok


def list_files(files: DataFrame, prefix: str = "", suffixes: Sequence[str] = (), limit: int = 100) -> DataFrame:
    """A listing for display, by path: the limit is part of it."""
    if prefix:
        files = files.where(F.col("path").startswith(prefix))
    if suffixes:
        files = files.where(reduce(lambda a, b: a | b, (F.col("path").endswith(s) for s in suffixes)))
    return files.orderBy("path").limit(limit)


#: Parts of a generated file's name, and languages whose symbols have nothing below them.
GENERATED = (".pb.", "_pb2.py", "_pb2_grpc.py", ".grpc.", ".gen.", "_gen.", ".generated.", "_generated.", "grpc_", "proto_")
CONFIG_LANGUAGES = ("terraform", "yaml", "properties", "nix", "solidity")


def is_generated(path: Column) -> Column:
    """Whether a file's name says that a tool wrote it."""
    name = F.lower(fn.base_name(path))
    return reduce(lambda a, b: a | b, (name.contains(x) for x in GENERATED))


def is_config_leaf(language: Column) -> Column:
    """Whether a symbol is an entry of a configuration, without anything below it."""
    return F.coalesce(language.isin(*CONFIG_LANGUAGES), F.lit(False))
