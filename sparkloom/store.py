"""A stored code graph: versions of Parquet tables under one folder, built and kept fresh from a source tree.

A version is written whole under its own name and then pointed to by a new marker file, so that a reader never sees half
of one and a failed sync changes nothing. Nodes and edges are sorted by file and source, with a second copy of the edges
by target; references are never consumed, so an incremental sync equals a rebuild.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.errors import NotInitialized, UnsafeRoot
from sparkloom.operators import mutations, resolve, search
from sparkloom.session import stored
from sparkloom.sources import extract, scan

#: Raised when extraction changes, so that older graphs count as stale.
EXTRACTION_VERSION = 2
TABLES = ("nodes", "edges", "refs", "files")


class GraphStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, str(folder).rstrip("/")
        jvm = spark._jvm
        self._path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    # -- life cycle --

    @classmethod
    def create(cls, spark: SparkSession, folder: str) -> GraphStore:
        """A new store; an existing one is left as it is. The root of a file system is refused."""
        if str(folder).rstrip("/").removeprefix("file:").strip("/") == "":
            raise UnsafeRoot(folder)
        store = cls(spark, folder)
        if not store.exists():
            store._fs.mkdirs(store._path("markers"))
        return store

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> GraphStore:
        store = cls(spark, folder)
        if not store.exists():
            raise NotInitialized(folder)
        return store

    def exists(self) -> bool:
        return self._fs.exists(self._path("markers"))

    def drop(self) -> None:
        if self.exists():
            self._fs.delete(self._path(), True)

    def _markers(self) -> list[dict]:
        rows = self.spark.read.option("wholetext", True).text(f"{self.folder}/markers").collect() if self._fs.listStatus(self._path("markers")) else []  # one a kept version
        return sorted((json.loads(r.value) for r in rows), key=lambda m: m["number"])

    def metadata(self) -> dict:
        """Of the current version: number, name, indexed_at, extraction_version, root; empty before the first."""
        found = self._markers()
        return found[-1] if found else {}

    def is_stale(self) -> bool:
        return self.metadata().get("extraction_version") != EXTRACTION_VERSION

    def vacuum(self) -> None:
        """Deletes all versions but the current one."""
        now = self.metadata()
        for m in self._markers():
            if m["number"] != now["number"]:
                if m["name"] != now["name"]:
                    self._fs.delete(self._path("versions", m["name"]), True)
                self._fs.delete(self._path("markers", f"{m['number']}.json"), False)

    # -- tables --

    def table(self, name: str) -> DataFrame:
        at = self.metadata()
        if not at:
            raise NotInitialized(self.folder)
        return self.spark.read.parquet(f"{self.folder}/versions/{at['name']}/{name}")

    nodes = property(lambda self: self.table("nodes"))
    edges = property(lambda self: self.table("edges"))
    edges_in = property(lambda self: self.table("edges_in"))
    refs = property(lambda self: self.table("refs"))
    files = property(lambda self: self.table("files"))

    @property
    def index(self) -> tuple[DataFrame, DataFrame]:
        """The inverted index of the symbols, sorted by term, and its totals."""
        return self.table("postings"), self.table("totals")

    def commit(self, nodes: DataFrame, edges: DataFrame, refs: DataFrame, files: DataFrame, **about) -> None:
        number, name = self.metadata().get("number", 0) + 1, uuid.uuid4().hex
        base = f"{self.folder}/versions/{name}"
        nodes.repartitionByRange("file_path", "start_line").sortWithinPartitions("file_path", "start_line").write.parquet(f"{base}/nodes")
        edges.repartitionByRange("source", "target").sortWithinPartitions("source", "kind").write.parquet(f"{base}/edges")
        self.spark.read.schema(edges.schema).parquet(f"{base}/edges").repartitionByRange("target", "source").sortWithinPartitions("target", "kind").write.parquet(f"{base}/edges_in")
        postings = search.inverted(self.spark.read.schema(nodes.schema).parquet(f"{base}/nodes"), "id")
        postings.repartitionByRange("term", "id").sortWithinPartitions("term").write.parquet(f"{base}/postings")
        search.index_totals(self.spark.read.schema(postings.schema).parquet(f"{base}/postings"), "id").write.parquet(f"{base}/totals")
        refs.write.parquet(f"{base}/refs")
        files.write.parquet(f"{base}/files")
        self._mark(number, {"number": number, "name": name, "indexed_at": int(time.time() * 1000), "extraction_version": EXTRACTION_VERSION, "values": self.metadata().get("values", {}), **about})

    def _mark(self, number: int, about: dict) -> None:
        """Makes a version the current one; of two writers at once one fails."""
        out = self._fs.create(self._path("markers", f"{number}.json"), False)
        out.write(json.dumps(about).encode())
        out.close()

    def set_value(self, key: str, value: str) -> None:
        """Keeps a value under a key, from now on and in later versions."""
        now = self.metadata()
        if not now:
            raise NotInitialized(self.folder)
        self._mark(now["number"] + 1, now | {"number": now["number"] + 1, "values": now.get("values", {}) | {key: value}})

    def value(self, key: str) -> str | None:
        return self.metadata().get("values", {}).get(key)

    def compact(self) -> None:
        """Writes the current version again in files of even size, then deletes the others."""
        now = self.metadata()
        if now:
            about = {k: v for k, v in now.items() if k not in ("number", "name", "indexed_at", "extraction_version")}
            self.commit(self.nodes, self.edges, self.refs.coalesce(max(1, self.refs.rdd.getNumPartitions() // 2)), self.files.coalesce(1) if self.files.count() < 1 << 20 else self.files, **about)
            self.vacuum()

    # -- building --

    def sync(self, root: str, options: scan.ScanOptions | None = None, rebuild: bool = False, only: list[str] | None = None) -> dict[str, int]:
        """Brings the graph up to date with a tree; counts of added, modified, removed and unchanged files.

        Only files whose size or time differ are read, and only those whose contents differ are parsed. Edges are resolved
        again from all references, as a new definition may change what other files mean. only: these paths are looked at,
        whatever their time, and no others; the counts are of them.
        """
        spark, old = self.spark, None if rebuild or not self.metadata() else self.files
        everything = old
        listed = scan.scan(spark, root, options, only=only)
        if only is not None and old is not None:
            old = old.where(F.col("path").isin(only))
        if old is not None:
            same = old.select("path", F.col("modified_at").alias("_m"), F.col("size").alias("_s"))
            moved = F.lit(True) if only is not None else F.expr("_m IS NULL OR _m <> modified_at OR _s <> size")
            maybe = stored(listed.join(same, "path", "left").where(moved).select("path"), "maybe")
            n = maybe.count()
            if n <= scan.NAMED_FILES:
                sources = scan.read_sources(spark, root, options, only=[r.path for r in maybe.collect()])
            else:
                sources = scan.read_sources(spark, root, options).join(maybe, "path", "left_semi")
        else:
            sources = scan.read_sources(spark, root, options, only=only)
        sources = stored(sources, "sources")
        hashes = listed.select("path").join(sources.select("path", "content_hash"), "path", "left")
        if old is not None:
            hashes = hashes.join(old.select("path", F.col("content_hash").alias("_h")), "path", "left").select("path", F.coalesce("content_hash", "_h").alias("content_hash"))
            change = stored(mutations.file_changes(old, hashes), "changes")
        else:
            change = stored(hashes.select("path", F.lit("added").alias("change")), "changes")
        fresh = sources.join(change.where("change <> 'removed'"), "path", "left_semi")
        rows = stored(extract.extract(fresh.where("problem IS NULL")), "rows")
        nodes, edges, refs = extract.split(rows)
        edges = edges.withColumn("provenance", F.lit(None).cast("string"))
        counted = rows.where("rec = 'node'").groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("node_count"))
        files = fresh.join(counted, "path", "left").select("path", "language", "size", "modified_at", "content_hash", F.coalesce("node_count", F.lit(0)).cast("long").alias("node_count"), "problem")
        counts = {r.change: r.n for r in change.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows at most
        if old is not None:
            if not counts:
                return {"added": 0, "modified": 0, "removed": 0, "unchanged": listed.count()}
            # a file that only has a new time keeps its rows
            kept_nodes, kept_edges, kept_refs = mutations.delete_files(self.nodes, self.edges.where("provenance IS NULL"), self.refs, change)
            nodes, edges, refs = kept_nodes.unionByName(nodes), kept_edges.unionByName(edges), kept_refs.unionByName(refs)
            touched = sources.select("path", F.col("modified_at").alias("_m"))
            kept = everything.join(change, "path", "left_anti").join(touched, "path", "left").withColumn("modified_at", F.coalesce("_m", "modified_at")).drop("_m")
            files = kept.unionByName(files)
        nodes, refs, files = stored(nodes.dropDuplicates(["id"]), "nodes"), stored(refs, "refs"), stored(files, "files")
        found = resolve.resolved_edges(with_ids(refs), nodes, files.where("problem IS NULL"))
        all_edges = edges.unionByName(found.withColumn("metadata", F.lit(None).cast("string")))
        self.commit(nodes, mutations.distinct_edges(mutations.with_both_ends(all_edges, nodes)), refs, files, root=str(root))
        counts = {k: counts.get(k, 0) for k in ("added", "modified", "removed")}
        return counts | {"unchanged": listed.count() - counts["added"] - counts["modified"]}

    def pending(self, root: str, options: scan.ScanOptions | None = None) -> DataFrame:
        """(path, change) of what a sync would find, by time alone."""
        return mutations.file_changes(self.files, scan.scan(self.spark, root, options), "modified_at")


def with_ids(refs: DataFrame) -> DataFrame:
    """refs with ref_id; refs must be a stored table, so that the ids stay the same whenever it is read."""
    return refs.withColumn("ref_id", F.monotonically_increasing_id())


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
