"""The facade: a project's code graph, its upkeep and every question about it. Answers are DataFrames."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.errors import NodeNotFound
from sparkloom.operators import aggregates, graph, lookups, search
from sparkloom.plans import context
from sparkloom.session import ship
from sparkloom.sources import scan
from sparkloom.store import GraphStore, with_ids

FOLDER, CONFIG = ".sparkloom", "sparkloom.json"


class ProjectGraph:
    """init() and open() give one; the graph is kept in the project's own folder unless another is named."""

    def __init__(self, spark: SparkSession, root: str, store: GraphStore, options: scan.ScanOptions | None = None):
        self.spark, self.root, self.store = ship(spark), str(root), store
        self.options = options or self._configured()
        self._lock = threading.Lock()

    def _configured(self) -> scan.ScanOptions:
        """The project's own settings, from the file that it may have."""
        at = Path(self.root, CONFIG)
        return scan.ScanOptions.from_json(at.read_text()) if at.exists() else scan.ScanOptions()

    # -- life cycle --

    @staticmethod
    def _folder(root: str, folder: str | None) -> str:
        return folder or f"{str(root).rstrip('/')}/{FOLDER}"

    @classmethod
    def init(cls, spark: SparkSession, root: str, folder: str | None = None, options: scan.ScanOptions | None = None) -> ProjectGraph:
        return cls(spark, root, GraphStore.create(spark, cls._folder(root, folder)), options)

    @classmethod
    def open(cls, spark: SparkSession, root: str, folder: str | None = None, options: scan.ScanOptions | None = None) -> ProjectGraph:
        return cls(spark, root, GraphStore.open(spark, cls._folder(root, folder)), options)

    @classmethod
    def is_initialized(cls, spark: SparkSession, root: str, folder: str | None = None) -> bool:
        return GraphStore(spark, cls._folder(root, folder)).exists()

    def uninitialize(self) -> None:
        self.store.drop()

    # -- upkeep --

    def index_all(self, force: bool = False) -> dict[str, int]:
        """A full index; force parses every file again."""
        return self.sync(rebuild=force)

    def index_files(self, paths: list[str]) -> dict[str, int]:
        """Takes in the named files, relative to the root, and no others: those whose contents haven't changed aren't parsed."""
        return self.sync(only=[str(p) for p in paths])

    def index_file(self, path: str) -> dict[str, int]:
        return self.index_files([path])

    def reconcile(self) -> dict[str, int]:
        """A sync if sizes, times or names say that something changed since the last one; what a server does when a client comes."""
        return {"added": 0, "modified": 0, "removed": 0} if self.changed_files().isEmpty() else self.sync()

    def sync(self, rebuild: bool = False, only: list[str] | None = None) -> dict[str, int]:
        with self._lock:
            options = self.options
            ignore = Path(self.root, ".gitignore")
            if not options.ignore_file and ignore.exists():
                options = scan.ScanOptions(options.include, options.exclude, options.extensions, ignore.read_text(), options.respect_ignore)
            return self.store.sync(self.root, options, rebuild, only)

    def changed_files(self) -> DataFrame:
        return self.store.pending(self.root, self.options)

    def watch(self, done: Callable[[dict[str, int]], None] = lambda _: None, poll: float = 1.0, debounce: float = 2.0) -> Callable[[], None]:
        """Syncs after changes that were followed by `debounce` seconds without any; returns what stops it."""
        stop = threading.Event()

        def run():
            seen = since = None
            while not stop.wait(poll):
                now = frozenset(map(tuple, self.changed_files().collect()))
                if now != seen:
                    seen, since = now, time.time()
                elif now and time.time() - since >= debounce:
                    done(self.sync())
                    seen = None

        threading.Thread(target=run, daemon=True).start()
        return stop.set

    # -- tables --

    nodes = property(lambda self: self.store.nodes)
    edges = property(lambda self: self.store.edges)
    edges_in = property(lambda self: self.store.edges_in)
    files = property(lambda self: self.store.files)
    refs = property(lambda self: self.store.refs)

    @property
    def unresolved(self) -> DataFrame:
        """References without an edge."""
        from sparkloom.operators.resolve import resolve

        refs = with_ids(self.refs)
        return refs.join(resolve(refs, self.nodes, self.files), "ref_id", "left_anti").drop("ref_id")

    # -- look-ups and search --

    def search(self, query: str, limit: int = 20, mode: str = "text", **filters) -> DataFrame:
        return search.search(self.nodes, query, limit, mode, self.store.index, **filters)

    def node(self, node: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node)

    def nodes_by_name(self, name: str) -> DataFrame:
        return lookups.by_name(self.nodes, name)

    def nodes_by_file(self, path: str) -> DataFrame:
        return lookups.by_file(self.nodes, path)

    def nodes_by_files(self, paths: list[str]) -> DataFrame:
        return lookups.nodes_by_file(self.nodes, self.spark.createDataFrame([(p,) for p in paths], "path string"))

    def files_summary(self) -> DataFrame:
        return aggregates.files_summary(self.files, self.nodes)

    def segment_matches(self, words: list[str]) -> DataFrame:
        return search.segment_matches(self.nodes, words)

    def id_of(self, name: str) -> str:
        """The id that a name stands for: an id itself, else the best symbol found for it."""
        if found := self.node(name).select("id").first():
            return found.id
        for hidden in (("file", "import"), ("file",)):  # a definition before an import of it
            if found := search.best_node(self.nodes.where(~F.col("kind").isin(*hidden)), name).first():
                return found.id
        raise NodeNotFound(name)

    # -- graph --

    def _ids(self, nodes: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in nodes], "id string")

    def _callers(self, ids: DataFrame) -> DataFrame:
        return graph.callers(self.nodes, self.edges_in, self.refs, ids)

    def _callees(self, ids: DataFrame) -> DataFrame:
        return graph.callees(self.nodes, self.edges, self.refs, ids)

    def callers(self, node: str, depth: int = 1) -> DataFrame:
        if depth <= 1:
            return self._callers(self._ids([node])).select(F.col("caller").alias("id"), "via")
        step = lambda ids, n: self._callers(ids).select(F.col("target").alias("a"), F.col("caller").alias("b"))
        return graph.reach_by(step, graph.from_one(self.spark, node), depth).where("depth > 0").select("id", "depth")

    def callees(self, node: str, depth: int = 1) -> DataFrame:
        if depth <= 1:
            return self._callees(self._ids([node])).select(F.col("callee").alias("id"), "via")
        step = lambda ids, n: self._callees(ids).select(F.col("source").alias("a"), F.col("callee").alias("b"))
        return graph.reach_by(step, graph.from_one(self.spark, node), depth).where("depth > 0").select("id", "depth")

    def callers_batch(self, nodes: list[str]) -> DataFrame:
        return self._callers(self._ids(nodes))

    def callees_batch(self, nodes: list[str]) -> DataFrame:
        return self._callees(self._ids(nodes))

    def impact(self, node: str, depth: int = 3) -> DataFrame:
        return graph.traverse(self.edges, node, depth, "both", edges_in=self.edges_in)

    def impact_risk(self, node: str, depth: int = 3) -> DataFrame:
        return graph.risk(graph.touched_edges(self.edges, self.impact(node, depth), depth)).orderBy(F.desc("degree"), "id")

    def call_graph(self, node: str, depth: int = 2) -> DataFrame:
        return graph.traverse(self.edges, node, depth, "both", graph.USES, self.edges_in)

    def neighbourhood(self, node: str, depth: int = 2) -> DataFrame:
        """(section, id, detail): what leads to a symbol and where it leads, its callers and callees to that depth, its types."""
        way = lambda section, d: graph.traverse(self.edges, node, depth, d, edges_in=self.edges_in).where("depth > 0").select(F.lit(section).alias("section"), "id", F.col("depth").cast("string").alias("detail"))
        deep = lambda section, df: df.select(F.lit(section).alias("section"), "id", F.col("depth").cast("string").alias("detail"))
        types = self.type_hierarchy(node).select(F.lit("types").alias("section"), F.col("relative").alias("id"), F.col("kind").alias("detail"))
        return way("incoming", "in").unionByName(way("outgoing", "out")).unionByName(deep("callers", self.callers(node, max(depth, 2)))).unionByName(deep("callees", self.callees(node, max(depth, 2)))).unionByName(types)

    def find_path(self, start: str, end: str, kinds: list[str] | None = None, max_nodes: int = 20) -> DataFrame:
        return graph.find_path(self.edges, start, end, max_nodes, kinds)

    def type_hierarchy(self, node: str) -> DataFrame:
        return graph.hierarchy(self.edges).where(F.col("id") == node)

    def file_dependencies(self, path: str, levels: int | None = None) -> DataFrame:
        return graph.file_closure(self.nodes, self.edges, levels, self.spark.createDataFrame([(path,)], "path string"))

    def file_dependents(self, path: str) -> DataFrame:
        return graph.file_dependents(self.nodes, self.edges).where(F.col("file") == path)

    def circular_dependencies(self) -> DataFrame:
        return graph.strong_components(self.edges)

    def dead_code(self, kinds: list[str] | None = None) -> DataFrame:
        found = graph.dead_code(self.nodes, self.edges).join(self.nodes.select("id", "kind", "name", "file_path"), "id")
        return found.where(F.col("kind").isin(*kinds)) if kinds else found

    def exported_symbols(self, path: str) -> DataFrame:
        return graph.exported_symbols(self.nodes, self.edges).where(F.col("file_path") == path)

    def metrics(self) -> DataFrame:
        return graph.metrics(self.nodes, self.edges)

    def affected_tests(self, paths: list[str], depth: int = 2) -> DataFrame:
        return graph.affected_tests(self.nodes, self.edges, self.spark.createDataFrame([(p,) for p in paths], "path string"), depth)

    # -- composed --

    def explore(self, query: str, limit: int = 20, **filters) -> DataFrame:
        return context.explore(self.nodes, self.edges, self.refs, query, limit, self.edges_in, **filters)

    def context(self, node: str, depth: int = 3) -> DataFrame:
        return context.focal(self.nodes, self.edges, node, depth)

    def task_context(self, query: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(nodes, edges, code blocks) of a task."""
        nodes, edges = context.task(self.nodes, self.edges, query)
        first = nodes.where("kind <> 'file'").orderBy("file_path", "start_line", "id").limit(10)
        paths = [r.file_path for r in first.select("file_path").distinct().collect()]  # of the ten blocks that are shown
        return nodes, edges, context.code_blocks(nodes, scan.read_sources(self.spark, self.root, self.options, only=paths))

    # -- state --

    def stats(self) -> DataFrame:
        return aggregates.totals(self.nodes, self.edges, self.files, self.refs)

    def set_value(self, key: str, value: str) -> None:
        self.store.set_value(key, value)

    def value(self, key: str) -> str | None:
        return self.store.value(key)

    def last_indexed_at(self) -> int | None:
        return self.store.metadata().get("indexed_at")

    def is_stale(self) -> bool:
        return self.store.is_stale()
