"""Every operator as a query over the derived code graph and the test tables, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import display
from sparkloom.functions import text as fn
from sparkloom.operators import aggregates, graph, lookups, mutations, resolve, search
from sparkloom.plans import context
from sparkloom.session import stored
from sparkloom.sources import extract
from sparkloom.sources.derived import Derived, with_views
from sparkloom.streaming import changes

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(views: str = "", sql: str | None = None, recursive: bool = False):
    """Registers a query by its function's name; sql sees the named views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (with_views(*views.split(), recursive=recursive) + ("," if sql.lstrip().startswith(",") else "\n") + sql.lstrip().removeprefix(",")) if views else sql
        return f

    return add


def _hub(g: Derived) -> str:
    """The symbol with the most incoming calls: the start of the queries about one symbol."""
    return g.edges.where("kind = 'calls'").groupBy("target").count().orderBy(F.desc("count"), "target").first().target


HUB = "(SELECT target FROM g_edges WHERE kind = 'calls' GROUP BY target ORDER BY count(*) DESC, target LIMIT 1)"
FILE = "(SELECT file_path FROM g_sym GROUP BY file_path ORDER BY count(*) DESC, file_path LIMIT 1)"
NAME = "(SELECT name FROM g_sym GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


def _file(g: Derived) -> str:
    return g.sym.groupBy("file_path").count().orderBy(F.desc("count"), "file_path").first().file_path


def _name(g: Derived) -> str:
    return g.sym.groupBy("name").count().orderBy(F.desc("count"), "name").first().name


NODE_COLS = "id, kind, name, file_path, start_line"


def _node(df: DataFrame) -> DataFrame:
    return df.select(*NODE_COLS.split(", "))


# ---- look-ups and filters ----


@query("g_nodes", "SELECT id, kind, name, qualified_name, start_line FROM g_nodes WHERE id IN (SELECT 'file:' || path FROM g_files)")
def q_lkp_by_ids(g):
    return lookups.by_ids(g.nodes, g.files.select(F.concat(F.lit("file:"), "path").alias("id"))).select("id", "kind", "name", "qualified_name", "start_line")


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE file_path = {FILE}")
def q_lkp_by_file(g):
    return _node(lookups.by_file(g.nodes, _file(g)))


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE kind = 'class'")
def q_lkp_by_kind(g):
    return _node(lookups.by_kind(g.nodes, "class"))


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE name = {NAME}")
def q_lkp_by_name(g):
    return _node(lookups.by_name(g.nodes, _name(g)))


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE name >= 'red_' AND name < 'red`'")
def q_lkp_prefix(g):
    return _node(lookups.by_prefix(g.nodes, "red_"))


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE qualified_name = (SELECT min(qualified_name) FROM g_sym)")
def q_lkp_qualified(g):
    return _node(lookups.by_qualified_name(g.nodes, g.sym.agg(F.min("qualified_name")).first()[0]))


@query("g_edges", f"SELECT source, target, kind, line FROM g_edges WHERE source = {HUB} AND kind IN ('calls', 'references')")
def q_lkp_edges_out(g):
    return lookups.edges_of(g.edges, _hub(g), "source", ["calls", "references"])


@query("g_edges", f"SELECT source, target, kind, line FROM g_edges WHERE target = {HUB}")
def q_lkp_edges_in(g):
    return lookups.edges_of(g.edges, _hub(g), "target")


@query("g_edges", "SELECT source, target, kind, line FROM g_edges JOIN (SELECT source, target, kind FROM g_edges WHERE kind = 'calls' ORDER BY source, target LIMIT 1) USING (source, target, kind)")
def q_lkp_edge_between(g):
    e = g.edges.where("kind = 'calls'").orderBy("source", "target").first()
    return lookups.edge_between(g.edges, e.source, e.target, "calls")


def _batch(g, end):
    other = "target" if end == "source" else "source"
    got = lookups.edges_by_node(g.nodes, g.edges, end)
    return got.select("id", F.size("edges").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("edges", lambda e: F.concat_ws("|", e["kind"], e[other]))), ";").alias("edges"))


BATCH = "SELECT id, count({o}) AS n, coalesce(string_agg(kind2 || '|' || {o}, ';' ORDER BY kind2 || '|' || {o}), '') AS edges FROM (SELECT n.id, e.kind AS kind2, e.{o} FROM g_nodes n LEFT JOIN g_edges e ON e.{e} = n.id) GROUP BY id"


@query("g_nodes g_edges", BATCH.format(o="target", e="source"))
def q_lkp_batch_out(g):
    return _batch(g, "source")


@query("g_nodes g_edges", BATCH.format(o="source", e="target"))
def q_lkp_batch_in(g):
    return _batch(g, "target")


@query("g_nodes", "SELECT file_path, string_agg(id, ';' ORDER BY start_line, id) AS nodes FROM g_nodes WHERE file_path IN (SELECT path FROM g_files) GROUP BY file_path")
def q_lkp_nodes_by_files(g):
    return lookups.nodes_by_file(g.nodes, g.files).select("file_path", F.array_join(F.transform("nodes", lambda x: x["id"]), ";").alias("nodes"))


@query("g_refs", f"SELECT from_node_id, file_path, line, reference_kind, reference_name FROM g_refs WHERE reference_name = {NAME}")
def q_lkp_refs_by_name(g):
    return lookups.refs_where(g.refs, name=_name(g))


@query("g_files", "SELECT path, language, node_count FROM g_files ORDER BY path LIMIT 1")
def q_lkp_file(g):
    return g.files.where(F.col("path") == g.files.agg(F.min("path")).first()[0]).select("path", "language", "node_count")


SEGMENTS = "list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '-', '_', 'g')), '_'), lambda x: x <> '')"


@query("g_nodes", f"SELECT DISTINCT unnest({SEGMENTS.format('name')}) AS segment, name FROM g_nodes")
def q_lkp_segments(g):
    return lookups.segment_vocabulary(g.nodes)


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE kind IN ('class', 'function') AND language IN ('python', 'go') AND regexp_full_match(file_path, 'brand_[12].*/.*') AND NOT regexp_full_match(file_path, '.*_test[.].*')")
def q_flt_glob(g):
    return _node(g.nodes.where(lookups.matching(kinds=["class", "function"], languages=["python", "go"], include=["brand_[12]*/*"], exclude=["*_test.*"])))


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE starts_with(name, '_')")
def q_flt_visibility(g):
    return _node(g.nodes.where(lookups.matching(visibility="private")))


@query("g_nodes", f"SELECT {NODE_COLS} FROM g_nodes WHERE (contains(lower(file_path), 'brand_3') OR contains(lower(file_path), 'rs')) AND regexp_full_match(lower(file_path), '.*/s.*')")
def q_flt_paths(g):
    return _node(g.nodes.where(lookups.matching(paths=["brand_3", "RS"], include=["*/S*"], ignore_case=True)))


@query("g_files", "SELECT path, language FROM g_files WHERE starts_with(path, 'brand_') AND (ends_with(path, '.py') OR ends_with(path, '.go')) ORDER BY path LIMIT 100")
def q_flt_files(g):
    return lookups.list_files(g.files, "brand_", [".py", ".go"]).select("path", "language")


LANG = "CASE regexp_extract({0}, '[.][^./]+$') WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'go' WHEN '.java' THEN 'java' WHEN '.rs' THEN 'rust' WHEN '.c' THEN 'c' END"


@query("g_files", f"SELECT path, {LANG.format('path')} AS language FROM g_files")
def q_src_language(g):
    return g.files.select("path", fn.language_of(F.col("path")).alias("language"))


@query("g_files", "SELECT path, NOT (regexp_matches(path, '_test[.][^/]*$') AND NOT starts_with(path, 'brand_1')) AND NOT ends_with(path, '.rs') AS wanted FROM g_files")
def q_src_ignore(g):
    from sparkloom.sources.scan import ignore_rules, ignored

    return g.files.select("path", (~ignored(F.col("path"), ignore_rules("*_test.*\n!brand_1*/*_test.*\n# all of one language\n*.rs\n"))).alias("wanted"))


# ---- mutations ----


@query("g_changes", "SELECT path, event_id, change_type FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS n FROM g_changes) WHERE n = 1")
def q_snk_upsert_last_wins(g):
    c = g.changes.withColumn("seq", F.struct("ts", "event_id"))
    return mutations.upsert(c.where("change_type = 'added'"), c.where("change_type <> 'added'"), "path", "seq").select("path", "event_id", "change_type")


@query("g_nodes", "SELECT id, CASE WHEN kind = 'import' THEN 'seen' ELSE name END AS name, kind FROM g_nodes")
def q_snk_update(g):
    return mutations.update(g.nodes.select("id", "name", "kind"), g.nodes.where("kind = 'import'").select("id", F.lit("seen").alias("name")))


@query("g_edges", "SELECT DISTINCT source, target, kind, line FROM g_edges")
def q_snk_edge_identity(g):
    return mutations.distinct_edges(g.edges.unionByName(g.edges))


@query("g_nodes g_edges", "SELECT source, target, kind, line FROM g_edges UNION ALL SELECT source, target, kind, line FROM g_edges WHERE kind = 'calls'")
def q_snk_fk_reject(g):
    broken = g.edges.select("source", F.concat(F.lit("missing:"), "target").alias("target"), "kind", "line")
    return mutations.with_both_ends(g.edges.unionByName(broken).unionByName(g.edges.where("kind = 'calls'")), g.nodes)


GONE = ", gone AS (SELECT id FROM g_nodes WHERE language = 'go')"


@query("g_nodes g_edges g_refs", GONE + """ SELECT 'nodes' AS tbl, count(*) AS n FROM g_nodes WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edges', count(*) FROM g_edges WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'refs', count(*) FROM g_refs WHERE from_node_id NOT IN (SELECT id FROM gone)""")
def q_snk_cascade_delete(g):
    kept = mutations.delete_files(g.nodes, g.edges, g.refs, g.files.where("language = 'go'"))
    out = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t, df in zip(("nodes", "edges", "refs"), kept)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("g_nodes g_edges", GONE + " SELECT source, target, kind, line FROM g_edges WHERE source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone)")
def q_snk_edges_touching(g):
    return mutations.edges_touching(g.edges, g.nodes, g.files.where("language = 'go'"))


# ---- aggregates ----


@query("g_nodes g_edges g_refs", "SELECT 'nodes' AS metric, count(*) AS n FROM g_nodes UNION ALL SELECT 'edges', count(*) FROM g_edges UNION ALL SELECT 'files', count(*) FROM g_files UNION ALL SELECT 'refs', count(*) FROM g_refs")
def q_agg_stats(g):
    return aggregates.totals(g.nodes, g.edges, g.files, g.refs)


@query("g_nodes", "SELECT kind, count(*) AS n FROM g_nodes GROUP BY kind")
def q_agg_nodes_by_kind(g):
    return aggregates.counts_by(g.nodes, "kind").orderBy(F.desc("n"), "kind")


@query("g_edges", "SELECT kind, count(*) AS n FROM g_edges GROUP BY kind")
def q_agg_edges_by_kind(g):
    return aggregates.counts_by(g.edges, "kind")


@query("g_files", "SELECT language, count(*) AS n FROM g_files GROUP BY language")
def q_agg_files_by_language(g):
    return aggregates.counts_by(g.files, "language")


@query("g_nodes", """SELECT path, language, sum(n)::BIGINT AS total, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds
FROM g_files JOIN (SELECT file_path AS path, kind, count(*) AS n FROM g_nodes GROUP BY ALL) USING (path) GROUP BY path, language""")
def q_agg_files_summary(g):
    got = aggregates.files_summary(g.files, g.nodes)
    return got.withColumn("kinds", F.array_join(F.transform(F.map_entries("kinds"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


@query("g_files g_refs", "SELECT count(*) AS n FROM g_refs WHERE file_path IN (SELECT path FROM g_files WHERE language = 'rust')")
def q_agg_refs_of_files(g):
    return lookups.refs_where(g.refs, paths=g.files.where("language = 'rust'")).agg(F.count(F.lit(1)).alias("n"))


CALLER_PAIRS = ", p AS (SELECT DISTINCT e.target, a.id, a.name, a.file_path FROM g_edges e JOIN g_nodes a ON a.id = e.source WHERE e.kind IN ('calls', 'references') AND e.source <> e.target)"


@query("g_nodes g_edges", CALLER_PAIRS + """, f AS (SELECT target, file_path, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM p GROUP BY ALL)
SELECT target, sum(n)::BIGINT AS n_callers, count(*) AS n_files, string_agg(file_path || ':' || n || ':' || names, ';' ORDER BY file_path) AS files FROM f GROUP BY target""")
def q_agg_caller_summary(g):
    at = g.nodes.select(F.col("id").alias("caller"), F.col("name").alias("caller_name"), F.col("file_path").alias("caller_file"))
    pairs = g.edges.where(F.col("kind").isin(*graph.USES) & (F.col("source") != F.col("target"))).select("target", F.col("source").alias("caller")).distinct().join(at, "caller")
    got = aggregates.caller_summary(pairs)
    return got.withColumn("files", F.array_join(F.transform("files", lambda x: F.concat_ws(":", x["caller_file"], x["n"].cast("string"), F.array_join(x["names"], ","))), ";"))


@query("g_files", """SELECT dir, count(*) AS n_files, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, CASE WHEN count(*) <= 10 THEN string_agg(file, ',' ORDER BY file) END AS names
FROM (SELECT split_part(path, '/', 1) AS dir, split_part(path, '/', 2) AS file, language FROM g_files) GROUP BY dir""")
def q_agg_dirs(g):
    got = aggregates.directories(g.files)
    return got.withColumn("languages", F.array_join("languages", ",")).withColumn("names", F.array_join("names", ","))


# ---- graph ----


def _bfs_sql(way: str, depth: int, kinds: str = "", start: str = HUB) -> str:
    on = f" WHERE kind IN ({kinds})" if kinds else ""
    out, back = f"SELECT source AS a, target AS b FROM g_edges{on}", f"SELECT target AS a, source AS b FROM g_edges{on}"
    adj = {"out": out, "in": back, "both": f"{out} UNION {back}"}[way]
    return f""", adj AS ({adj}), r AS (SELECT {start} AS id, 0 AS depth UNION SELECT adj.b, r.depth + 1 FROM r JOIN adj ON adj.a = r.id WHERE r.depth < {depth}),
v AS (SELECT id, min(depth) AS depth FROM r GROUP BY id) """


CALLS, USE = "'calls', 'references', 'imports'", "'calls', 'references'"


@query("g_edges", _bfs_sql("out", 4, CALLS) + "SELECT id, depth FROM v", True)
def q_grf_bfs_out(g):
    return graph.traverse(g.edges, _hub(g), 4, "out", ["calls", "references", "imports"])


@query("g_edges", _bfs_sql("in", 4, CALLS) + "SELECT id, depth FROM v", True)
def q_grf_bfs_in(g):
    return graph.traverse(g.edges, _hub(g), 4, "in", ["calls", "references", "imports"])


@query("g_edges", _bfs_sql("both", 3) + "SELECT id, depth FROM v", True)
def q_grf_impact(g):
    return graph.traverse(g.edges, _hub(g), 3, "both")


@query("g_edges", _bfs_sql("both", 2) + ", i AS (SELECT id FROM v WHERE depth < 2) SELECT source, target, kind, line FROM g_edges WHERE source IN (SELECT id FROM i) UNION ALL SELECT source, target, kind, line FROM g_edges WHERE target IN (SELECT id FROM i)", True)
def q_grf_impact_edges(g):
    return graph.touched_edges(g.edges, graph.traverse(g.edges, _hub(g), 2, "both"), 2)


@query("g_edges", _bfs_sql("in", 3, USE) + "SELECT id, depth FROM v WHERE depth > 0", True)
def q_grf_callers(g):
    return graph.traverse(g.edges, _hub(g), 3, "in", graph.USES).where("depth > 0")


@query("g_edges", _bfs_sql("out", 3, USE) + "SELECT id, depth FROM v WHERE depth > 0", True)
def q_grf_callees(g):
    return graph.traverse(g.edges, _hub(g), 3, "out", graph.USES).where("depth > 0")


@query("g_edges", _bfs_sql("both", 2, USE) + "SELECT id, depth FROM v", True)
def q_grf_call_graph(g):
    return graph.traverse(g.edges, _hub(g), 2, "both", graph.USES)


@query("g_edges", f""", adj AS (SELECT DISTINCT source AS a, target AS b FROM g_edges WHERE kind IN ({CALLS}) AND source <> target),
kids AS (SELECT a, list(b ORDER BY b DESC) AS k FROM adj GROUP BY a),
d AS (SELECT [{{'id': {HUB}, 'depth': 0}}] AS todo, CAST([] AS VARCHAR[]) AS seen, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS INT) AS depth
  UNION ALL SELECT CASE WHEN list_contains(seen, p.id) OR p.depth >= 4 OR k IS NULL THEN rest ELSE list_concat(rest, list_transform(k, lambda x: {{'id': x, 'depth': p.depth + 1}})) END,
    CASE WHEN list_contains(seen, p.id) THEN seen ELSE list_append(seen, p.id) END, CASE WHEN NOT list_contains(seen, p.id) THEN p.id END, p.depth
  FROM (SELECT todo[-1] AS p, todo[:-2] AS rest, seen FROM d WHERE len(todo) > 0) LEFT JOIN kids ON a = p.id)
SELECT id, depth, CAST(len(seen) - 1 AS INT) AS position FROM d WHERE id IS NOT NULL""", True)
def q_grf_dfs(g):
    """Depth first with a stack of its own: the SQL goes one step a row."""
    return graph.depth_first(g.edges, _hub(g), 4, "out", ["calls", "references", "imports"])


@query("g_edges", _bfs_sql("out", 4, CALLS) + """, par AS (SELECT y.id, y.depth, min(x.id) AS parent FROM v y JOIN adj ON adj.b = y.id JOIN v x ON x.id = adj.a AND x.depth = y.depth - 1 GROUP BY y.id, y.depth),
p AS (SELECT id, 0 AS length, id AS path FROM v WHERE depth = 0 UNION ALL SELECT par.id, par.depth, p.path || ' > ' || par.id FROM p JOIN par ON par.parent = p.id AND par.depth = p.length + 1)
SELECT id, length, path FROM p""", True)
def q_grf_path(g):
    return graph.paths_from(g.edges, _hub(g), 5, ["calls", "references", "imports"]).withColumn("path", F.array_join("path", " > "))


@query("g_edges", """SELECT DISTINCT * FROM (SELECT source AS id, target AS relative, kind, 'up' AS direction FROM g_edges WHERE kind IN ('extends', 'implements')
UNION ALL SELECT target, source, kind, 'down' FROM g_edges WHERE kind IN ('extends', 'implements'))""")
def q_grf_hierarchy(g):
    return graph.hierarchy(g.edges)


@query("g_edges", """, adj AS (SELECT DISTINCT source AS a, target AS b FROM g_edges WHERE kind IN ('imports', 'calls') AND source <> target),
r AS (SELECT a, b FROM adj UNION SELECT r.a, adj.b FROM r JOIN adj ON adj.a = r.b)
SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a""", True)
def q_grf_cycles_scc(g):
    return graph.strong_components(g.edges)


ADJ = ", adj AS (SELECT DISTINCT source AS a, target AS b FROM g_edges WHERE kind IN ('imports', 'calls') AND source <> target)"


BACK = ", back AS (SELECT source, target, kind FROM g_edges UNION ALL SELECT target, source, kind FROM g_edges WHERE kind = 'calls' AND line = 2)"


@query("g_edges", BACK + ADJ.replace("g_edges", "back") + " SELECT x.a || ' > ' || x.b AS cycle FROM adj x JOIN adj y ON y.a = x.b AND y.b = x.a WHERE x.a < x.b")
def q_grf_cycles_len2(g):
    """Some calls are answered by calls back, as the tables have no pair that calls each other."""
    edges = g.edges.select("source", "target", "kind")
    back = g.edges.where("kind = 'calls' AND line = 2").select(F.col("target").alias("source"), F.col("source").alias("target"), "kind")
    return graph.simple_cycles(edges.unionByName(back), 2).select(F.array_join("cycle", " > ").alias("cycle"))


@query("g_edges", ADJ + " SELECT x.a || ' > ' || x.b || ' > ' || y.b AS cycle FROM adj x JOIN adj y ON y.a = x.b JOIN adj z ON z.a = y.b AND z.b = x.a WHERE x.a < x.b AND x.a < y.b AND x.b <> y.b")
def q_grf_cycles_len3(g):
    return graph.simple_cycles(g.edges, 3).select(F.array_join("cycle", " > ").alias("cycle"))


@query("g_nodes g_edges", """SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(fo, 0) AS fan_out, coalesce(fi, 0) AS fan_in FROM g_nodes
LEFT JOIN (SELECT source AS id, count(*) AS o, count(*) FILTER (kind IN ('calls', 'references')) AS fo FROM g_edges GROUP BY source) USING (id)
LEFT JOIN (SELECT target AS id, count(*) AS i, count(*) FILTER (kind IN ('calls', 'references')) AS fi FROM g_edges GROUP BY target) USING (id)""")
def q_grf_metrics(g):
    return graph.metrics(g.nodes, g.edges)


@query("g_nodes g_edges", """, adj AS (SELECT DISTINCT target AS a, source AS b FROM g_edges WHERE kind = 'calls' AND source <> target),
r AS (SELECT id AS root, id, 0 AS depth FROM g_nodes UNION SELECT r.root, adj.b, r.depth + 1 FROM r JOIN adj ON adj.a = r.id WHERE r.depth < 60),
m AS (SELECT root, id, min(depth) AS depth FROM r GROUP BY root, id)
SELECT root AS id, max(depth) AS call_depth FROM m GROUP BY root""", True)
def q_grf_call_depth(g):
    return graph.call_depths(g.nodes, g.edges)


EXPORTED = ", x AS (SELECT id FROM g_nodes WHERE is_exported UNION SELECT target FROM g_edges WHERE kind = 'exports')"


@query("g_nodes g_edges", EXPORTED + """ SELECT 'unexported_functions' AS bucket, id FROM g_nodes WHERE kind IN ('function', 'method') AND id NOT IN (SELECT id FROM x)
UNION ALL SELECT 'unreferenced', id FROM g_nodes WHERE kind IN ('function', 'method', 'class') AND id NOT IN (SELECT id FROM x) AND id NOT IN (SELECT target FROM g_edges WHERE kind IN ('calls', 'references', 'imports', 'extends', 'implements'))
UNION ALL SELECT 'unused_imports', id FROM g_nodes WHERE kind = 'import' AND id NOT IN (SELECT target FROM g_edges WHERE kind = 'references')""")
def q_grf_dead_code(g):
    return graph.dead_code(g.nodes, g.edges)


DEPS = ", d AS (SELECT a.file_path AS file, b.file_path AS depends_on, count(*) AS n_edges FROM g_edges e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target WHERE e.kind IN ('imports', 'references') AND a.file_path <> b.file_path GROUP BY ALL)"


@query("g_nodes g_edges", DEPS + " SELECT * FROM d")
def q_grf_file_deps(g):
    return graph.file_dependencies(g.nodes, g.edges)


@query("g_nodes g_edges", DEPS + """, r AS (SELECT DISTINCT file AS root, file AS id, 0 AS level FROM d UNION SELECT r.root, d.depends_on, r.level + 1 FROM r JOIN d ON d.file = r.id WHERE r.level < 12)
SELECT root AS file, id AS depends_on, min(level) AS level FROM r GROUP BY ALL HAVING min(level) > 0""", True)
def q_grf_file_deps_transitive(g):
    return graph.file_closure(g.nodes, g.edges)


@query("g_nodes g_edges", "SELECT b.file_path AS file, e.source AS dependent, e.kind FROM g_edges e JOIN g_nodes a ON a.id = e.source JOIN g_nodes b ON b.id = e.target WHERE e.kind <> 'contains' AND a.file_path <> b.file_path")
def q_grf_file_dependents(g):
    return graph.file_dependents(g.nodes, g.edges)


@query("g_nodes g_edges", EXPORTED + " SELECT file_path, id, name, kind FROM g_nodes WHERE kind <> 'file' AND id IN (SELECT id FROM x)")
def q_grf_exported(g):
    return graph.exported_symbols(g.nodes, g.edges)


@query("g_nodes g_edges", """, adj AS (SELECT source AS a, target AS b FROM g_edges UNION SELECT target, source FROM g_edges),
s AS (SELECT file_path AS path, id FROM g_nodes WHERE language = 'python'), one AS (SELECT path, id FROM s UNION SELECT s.path, b FROM s JOIN adj ON a = s.id),
two AS (SELECT path, id FROM one UNION SELECT one.path, b FROM one JOIN adj ON a = one.id)
SELECT DISTINCT two.path, n.file_path AS test FROM two JOIN g_nodes n USING (id) WHERE regexp_matches(n.file_path, '_test[.][^./]*$')""")
def q_grf_affected(g):
    return graph.affected_tests(g.nodes, g.edges, g.files.where("language = 'python'"))


@query("g_edges", _bfs_sql("both", 2) + """, i AS (SELECT id FROM v WHERE depth < 2), s AS (SELECT source, target FROM g_edges WHERE source IN (SELECT id FROM i) UNION ALL SELECT source, target FROM g_edges WHERE target IN (SELECT id FROM i)),
k AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM s UNION ALL SELECT target FROM s) GROUP BY id)
SELECT id, degree, CASE WHEN degree >= 10 THEN 'high' WHEN degree >= 3 THEN 'medium' ELSE 'low' END AS risk FROM k""", True)
def q_grf_risk(g):
    return graph.risk(graph.touched_edges(g.edges, graph.traverse(g.edges, _hub(g), 2, "both"), 2))


# ---- callers and callees, imports, context ----


@query("g_nodes g_edges", CALLER_PAIRS + " SELECT s.id, s.name, count(p.id) AS n_callers FROM g_nodes s JOIN p ON p.target = s.id GROUP BY ALL")
def q_callers_direct(g):
    return direct_callers(g)


def direct_callers(g: Derived) -> DataFrame:
    """(id, name, n_callers) of every symbol with direct callers."""
    pairs = g.edges.where(F.col("kind").isin(*graph.USES) & (F.col("source") != F.col("target"))).select("source", F.col("target").alias("id")).distinct()
    counts = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n_callers"))
    return counts.join(g.nodes.select("id", "name"), "id").select("id", "name", "n_callers")


DEF = ", df AS (SELECT i.id, arg_min(d.id, struct_pack(f := d.file_path, l := d.start_line, i := d.id)) AS definition FROM g_nodes i JOIN g_nodes d ON d.name = i.name AND d.file_path <> i.file_path AND d.kind NOT IN ('import', 'file') WHERE i.kind = 'import' GROUP BY i.id)"


@query("g_nodes", DEF + " SELECT id, definition FROM df")
def q_import_redirect(g):
    return graph.definition_of_imports(g.nodes)


CALLERS = DEF + """, asked AS (SELECT n.id AS target, coalesce(definition, n.id) AS meant FROM g_nodes n LEFT JOIN df USING (id) WHERE kind <> 'file'),
nm AS (SELECT n.id AS meant, r.from_node_id AS caller FROM g_refs r JOIN g_nodes n ON n.kind <> 'file' AND n.name = r.reference_name
  UNION SELECT n.id, r.from_node_id FROM g_refs r JOIN g_nodes n ON n.kind <> 'file' AND n.name = string_split(r.reference_name, '.')[-1]),
b AS (SELECT meant, caller, min(via) AS via FROM (SELECT target AS meant, source AS caller, 'edge' AS via FROM g_edges WHERE kind IN ('calls', 'references') UNION ALL SELECT meant, caller, 'name' FROM nm) GROUP BY ALL),
callers AS (SELECT target, caller, via FROM asked JOIN b USING (meant) WHERE caller <> target AND caller <> meant)"""
CALLEES = """, callees AS (SELECT source, callee, min(via) AS via FROM (SELECT source, target AS callee, 'edge' AS via FROM g_edges WHERE kind IN ('calls', 'references')
UNION ALL SELECT r.from_node_id, n.id, 'name' FROM g_refs r JOIN g_nodes n ON n.name = r.reference_name AND n.kind <> 'file' WHERE NOT contains(r.reference_name, '.')) WHERE source <> callee GROUP BY ALL)"""


@query("g_nodes g_edges g_refs", CALLERS + " SELECT * FROM callers")
def q_callers_merged(g):
    return graph.callers(g.nodes, g.edges, g.refs)


@query("g_nodes g_edges g_refs", CALLEES + " SELECT * FROM callees")
def q_callees_merged(g):
    return graph.callees(g.nodes, g.edges, g.refs)


# ---- search ----

TERMS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def _bm25_sql(table: str, key: str, columns: list[str], words: list[str], mode: str) -> str:
    """CTEs that end in `ranked` (key, rank); mode is AND or OR."""
    t = ", ".join(f"{TERMS.format(c)} AS t{i}" for i, c in enumerate(columns))
    size = " + ".join(f"len(t{i})" for i in range(len(columns)))
    tf = [" + ".join(f"len(list_filter(t{i}, lambda x: starts_with(x, '{w}')))" for i in range(len(columns))) for w in words]
    n = ", ".join(f"(SELECT count(*) FROM c WHERE f{j} > 0) AS n{j}" for j in range(len(words)))
    rank = " + ".join(f"greatest(ln((k.total - n{j} + 0.5::DOUBLE) / (n{j} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{j} * 2.2::DOUBLE / (f{j} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / k.mean))" for j in range(len(words)))
    return f""", t AS (SELECT {key}, {t} FROM {table}), c AS (SELECT {key}, {size} AS len, {", ".join(f"{x} AS f{j}" for j, x in enumerate(tf))} FROM t),
k AS (SELECT (SELECT count(*) FROM c) AS total, (SELECT avg(len) FROM c)::DOUBLE AS mean, {n}),
ranked AS (SELECT {key}, -({rank}) AS rank FROM c, k WHERE {f" {mode} ".join(f"f{j} > 0" for j in range(len(words)))})"""


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns))


@query("g_nodes", f"SELECT id, name FROM g_nodes WHERE name = {NAME}")
def q_sch_exact(g):
    return search.exact(g.nodes, _name(g), 1 << 30).select("id", "name")


CLASS = "CASE WHEN lower(name) = '{0}' THEN 0 WHEN starts_with(lower(name), '{0}') THEN 1 ELSE 2 END"


def _substring_sql(words: list[str], limit: int) -> str:
    per = " UNION ALL ".join(f"(SELECT id, {CLASS.format(w)} AS m, {k} AS w FROM g_nodes WHERE contains(lower(name), '{w}') OR contains(lower(qualified_name), '{w}') ORDER BY m, name, id LIMIT {limit})" for k, w in enumerate(words))
    return f"SELECT id, min(m) AS match_class FROM ({per}) GROUP BY id"


@query("g_nodes", _substring_sql(["red", "ing"], 20))
def q_sch_substring(g):
    return search.substring(g.nodes, ["red", "ing"], 20).select("id", "match_class")


WORDS = ["red", "ring"]
SYMBOLS = ["name", "qualified_name"]


@query("g_nodes", _bm25_sql("g_nodes", "id", SYMBOLS, WORDS, "AND") + "SELECT id, round(rank, 6) AS rank FROM ranked")
def q_sch_fts_and(g):
    return _rounded(search.bm25(g.nodes, list(search.COLUMNS), WORDS).select("id", "rank"), "rank")


@query("g_nodes", _bm25_sql("g_nodes", "id", SYMBOLS, WORDS, "OR") + "SELECT id, round(rank, 6) AS rank FROM ranked")
def q_sch_fts_or(g):
    return _rounded(search.bm25(g.nodes, list(search.COLUMNS), WORDS, False).select("id", "rank"), "rank")


BOOST = "CASE WHEN lower(name) = 'red ring' THEN 0.5 WHEN starts_with(lower(name), 'red ring') THEN 0.3 WHEN contains(lower(name), 'red') AND contains(lower(name), 'ring') THEN 0.2 WHEN contains(lower(name), 'red') OR contains(lower(name), 'ring') THEN 0.1 ELSE 0 END::DOUBLE"


@query("g_nodes", _bm25_sql("g_nodes", "id", SYMBOLS, WORDS, "AND") + f"""SELECT id, round(CASE WHEN b > 0 THEN least(1 - rank / 100 + b, 1.0::DOUBLE) ELSE 1 - rank / 100 END, 6) AS score
FROM (SELECT id, rank, {BOOST} AS b FROM ranked JOIN g_nodes USING (id) ORDER BY round(rank, 9), id LIMIT 20)""")
def q_sch_boost(g):
    found = search.bm25(g.nodes, list(search.COLUMNS), WORDS).withColumn("rank9", F.round("rank", 9)).orderBy("rank9", "id").limit(20)
    return _rounded(search.boosted(found.withColumn("score", 1 - F.col("rank") / 100), "red ring").select("id", "score"), "score")


@query("g_nodes", _substring_sql(["hot", "xq"], 20))
def q_sch_like_fallback(g):
    """A word of two letters keeps full text out of it."""
    found = search.search(g.nodes, "hot xq", 1 << 20)
    return search.substring(g.nodes, ["hot", "xq"], 20).join(found.select("id"), "id", "left_semi").select("id", "match_class")


@query("g_nodes", _bm25_sql("g_nodes", "id", SYMBOLS, ["blue"], "OR") + "SELECT id, round(abs(rank), 6) AS score FROM ranked JOIN g_nodes USING (id) WHERE kind = 'class' AND language = 'rust' AND contains(file_path, 'brand_1')")
def q_sch_fuzzy_dsl(g):
    return _rounded(search.fuzzy(g.nodes, "kind:class lang:rust path:brand_1 blue", 1 << 30).select("id", "score"), "score")


PROSE = "fetch the old config for a red ring handler"
PROSE_WORDS = "'fetch', 'get', 'load', 'retrieve', 'read', 'request', 'old', 'config', 'configuration', 'settings', 'options', 'red', 'ring', 'handler', 'callback', 'listener', 'on'"


@query("g_nodes", f""", s AS (SELECT DISTINCT unnest({SEGMENTS.format('name')}) AS segment, name FROM g_nodes)
SELECT name, file_path, string_agg(DISTINCT segment, ',' ORDER BY segment) AS matched_words, count(DISTINCT segment)::INT AS n_words FROM g_sym JOIN s USING (name) WHERE segment IN ({PROSE_WORDS}) GROUP BY name, file_path""")
def q_sch_prose(g):
    return search.prose(g.nodes, PROSE).withColumn("matched_words", F.array_join("matched_words", ","))


@query("g_nodes", f""", s AS (SELECT DISTINCT unnest({SEGMENTS.format('name')}) AS segment, name FROM g_nodes)
SELECT name, arg_min(segment, p) AS word FROM s JOIN (VALUES ('ring', 0), ('hot', 1), ('red', 2)) w(segment, p) USING (segment) GROUP BY name""")
def q_sch_segments(g):
    return search.segment_matches(g.nodes, ["ring", "hot", "Red", "x"])


@query("g_nodes", f"SELECT id, array_to_string({SEGMENTS.format('name')}, ' ') AS segments FROM g_nodes")
def q_fn_segments(g):
    return g.nodes.select("id", F.array_join(fn.segments(F.col("name")), " ").alias("segments"))


STOP = ", ".join(f"'{w}'" for w in sorted(fn.STOP_WORDS))


def _alias_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    return "CASE w " + " ".join(f"WHEN '{k}' THEN {quoted((k, *v))}" for k, v in sorted(fn.ALIASES.items())) + " ELSE [w] END"


@query("", f"""SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') AS words
FROM (SELECT conv_id, turn, flatten(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: len(w) > 1 AND w NOT IN ({STOP})), lambda w: {_alias_sql()})) AS l FROM conversations)""")
def q_fn_candidates(g):
    text = g.table("conversations")
    return text.select("conv_id", "turn", F.array_join(fn.candidates(F.col("text")), " ").alias("words"))


DOC_WORDS = ["the", "tion"]


@query("", "WITH " + _bm25_sql("documents", "doc_id", ["text"], DOC_WORDS, "AND").removeprefix(", ") + "SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def q_sch_documents_bm25(g):
    return _rounded(search.bm25(g.table("documents").select("doc_id", "text"), ["text"], DOC_WORDS).select("doc_id", "rank"), "rank")


@query("", "WITH " + _bm25_sql("documents", "doc_id", ["text"], DOC_WORDS, "OR").removeprefix(", ") + "SELECT doc_id, round(rank, 6) AS rank FROM ranked")
def q_sch_indexed_bm25(g):
    """From a stored inverted index, of which a question reads the entries of its terms."""
    made = search.inverted(g.table("documents"), "doc_id", ("text",)).repartitionByRange("term", "doc_id").sortWithinPartitions("term")
    index = stored(made, "index")
    return _rounded(search.indexed_bm25(index, stored(search.index_totals(index, "doc_id"), "totals"), "doc_id", DOC_WORDS, False), "rank")


@query("", f"SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY ALL")
def q_sch_postings(g):
    return search.postings(g.table("documents"), "doc_id", "text")


# ---- display, predicates, points ----


@query("g_nodes g_edges", f"SELECT {NODE_COLS} FROM g_nodes WHERE id = {HUB}")
def q_lkp_by_id(g):
    return _node(g.nodes.where(F.col("id") == _hub(g)))


@query("g_nodes", f"SELECT {NODE_COLS} FROM (SELECT * FROM g_nodes WHERE kind = 'method' ORDER BY name, id LIMIT 20)")
def q_sch_by_kind(g):
    """What a search for a kind without words shows."""
    return _node(lookups.by_kind(g.nodes, "method").limit(20))


@query("g_nodes", "SELECT kind, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, kind) AS place FROM g_nodes GROUP BY kind")
def q_agg_kind_order(g):
    got = aggregates.counts_by(g.nodes, "kind").orderBy(F.desc("n"), "kind")
    return got.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "kind")).cast("long"))  # a row a kind


@query("g_nodes", "SELECT file_path, CAST(row_number() OVER (ORDER BY min(place), file_path) - 1 AS INT) AS place FROM (SELECT file_path, row_number() OVER (ORDER BY name, id) AS place FROM g_nodes WHERE contains(lower(name), 'red')) GROUP BY file_path")
def q_agg_unique_files(g):
    found = g.nodes.where(F.lower("name").contains("red")).select("file_path", F.row_number().over(W.orderBy("name", "id")).alias("place"))
    return aggregates.unique_files(found)


@query("g_files", "SELECT path, regexp_matches(path, '_test[.]') OR language = 'rust' AS generated, language = 'go' AS config FROM g_files")
def q_flt_predicates(g):
    path = F.when(F.col("language") == "rust", F.regexp_replace("path", r"\.rs$", ".pb.rs")).otherwise(F.regexp_replace("path", r"_test\.", "_gen."))
    return g.files.select("path", lookups.is_generated(path).alias("generated"), lookups.is_config_leaf(F.when(F.col("language") == "go", "yaml").otherwise(F.col("language"))).alias("config"))


@query("", """SELECT l_orderkey, l_linenumber, format('{:,}', l_orderkey * 1000) AS n, CASE WHEN regexp_matches(w, '(s|x|ch|sh)$') THEN w || 'es' WHEN length(w) > 2 AND regexp_matches(w, '[^aeiou]y$') THEN left(w, -1) || 'ies' ELSE w || 's' END AS plural,
CASE WHEN l_partkey < 1000 THEN l_partkey || 'ms' WHEN l_partkey < 60000 THEN format('{:.1f}s', floor(l_partkey / 100) / 10) END AS took
FROM (SELECT l_orderkey, l_linenumber, l_partkey, lower(l_shipmode) AS w FROM (SELECT *, ['query', 'class', 'key', 'fox', 'file', 'branch'][1 + l_linenumber % 6] AS l_shipmode FROM lineitem))""")
def q_fn_display(g):
    w = F.element_at(F.array(*map(F.lit, ["query", "class", "key", "fox", "file", "branch"])), (F.col("l_linenumber") % 6 + 1).cast("int"))
    ms = F.when(F.col("l_partkey") < 1000, F.col("l_partkey")).otherwise(F.floor(F.col("l_partkey") / 100) * 100)
    return g.table("lineitem").select("l_orderkey", "l_linenumber", display.thousands(F.col("l_orderkey") * 1000).alias("n"), display.plural(w).alias("plural"), F.when(F.col("l_partkey") < 60000, display.duration(ms)).alias("took"))


@query("g_nodes", "SELECT id, 0.5::DOUBLE AS score FROM g_nodes WHERE contains(lower(name), 'd_r') OR contains(lower(qualified_name), 'd_r') OR contains(lower('about ' || kind || ' d_r'), 'd_r') AND kind = 'class'")
def q_sch_contains(g):
    """The step of fuzzy search after no word was found: any part, docstrings included."""
    nodes = g.nodes.withColumn("docstring", F.when(F.col("kind") == "class", F.concat(F.lit("about "), "kind", F.lit(" D_r"))))
    return search.containing(nodes, "D_r", 1 << 30).select("id", "score")


BLOCK = "trim(array_to_string(string_split(text, chr(10))[{a}:{b}], chr(10)))"


@query("", f"SELECT doc_id, CASE WHEN length(b) > 2000 THEN left(b, 2000) || chr(10) || '... (cut)' ELSE b END AS block FROM (SELECT doc_id, {BLOCK.format(a='1 + doc_id % 3', b='1 + doc_id % 3 + doc_id % 5')} AS b FROM documents)")
def q_fn_code_block(g):
    start = (F.col("doc_id") % 3 + 1).cast("int")
    return g.table("documents").select("doc_id", context.code_block(F.col("text"), start, (start + F.col("doc_id") % 5).cast("int")).alias("block"))


@query("g_nodes g_edges", _bm25_sql("g_nodes", "id", SYMBOLS, WORDS, "AND") + """, roots AS (SELECT id FROM ranked ORDER BY round(rank, 9), id LIMIT 5),
o AS (SELECT * FROM g_edges WHERE source IN (SELECT id FROM roots)), n AS (SELECT * FROM g_nodes WHERE id IN (SELECT id FROM roots UNION SELECT target FROM o)),
bl AS (SELECT n.id, trim(array_to_string(list_transform(range(start_line, greatest(end_line, start_line) + 1), lambda i: 'line ' || i || ' of ' || file_path), chr(10))) AS b FROM (SELECT * FROM n WHERE kind <> 'file' ORDER BY file_path, start_line, id LIMIT 10) n)
SELECT 'nodes' AS metric, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM (SELECT source, target, kind FROM o UNION SELECT source, target, kind FROM g_edges WHERE target IN (SELECT id FROM roots))
UNION ALL SELECT 'files', count(DISTINCT file_path) FROM n UNION ALL SELECT 'blocks', count(*) FROM bl UNION ALL SELECT 'code_size', CAST(coalesce(sum(CASE WHEN length(b) > 2000 THEN 2000 + 10 ELSE length(b) END), 0) AS BIGINT) FROM bl""")
def q_task_stats(g):
    """A task's context from its five best symbols, with the code blocks that are shown."""
    best = search.bm25(g.nodes, list(search.COLUMNS), WORDS).orderBy(F.round("rank", 9), "id").limit(5)
    nodes, edges = context.around(g.nodes, g.edges, stored(best.select("id"), "roots"))
    nodes = stored(nodes, "context")
    line = F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit(" of "), F.col("path")))
    sources = g.files.select("path", F.array_join(line, "\n").alias("text"))
    return context.stats(nodes, edges, context.code_blocks(nodes, sources))


# ---- composed ----


@query("g_nodes g_edges g_refs", _bm25_sql("g_nodes", "id", SYMBOLS, WORDS, "AND") + CALLERS + CALLEES + """ SELECT id, name, coalesce(a.n, 0) AS n_callers, coalesce(b.n, 0) AS n_callees
FROM (SELECT id FROM ranked ORDER BY round(rank, 9), id LIMIT 1000000) JOIN g_nodes USING (id) LEFT JOIN (SELECT target AS id, count(*) AS n FROM callers GROUP BY 1) a USING (id) LEFT JOIN (SELECT source AS id, count(*) AS n FROM callees GROUP BY 1) b USING (id)""")
def q_explore(g):
    found = stored(search.full_text(g.nodes, WORDS, 1000000).select("id"), "found")
    got = context.explore(g.nodes.join(found, "id", "left_semi"), g.edges, g.refs, "red ring", 1 << 20).select("id", "name")
    got = stored(got, "explored")
    ids = got.select("id")
    got = got.join(graph.caller_counts(g.nodes, g.edges, g.refs, ids), "id", "left").join(graph.callee_counts(g.nodes, g.edges, g.refs, ids), "id", "left")
    return got.select("id", "name", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_callers", "n_callees")))


@query("g_nodes g_edges", f""", h AS (SELECT {HUB} AS id), e AS (SELECT * FROM g_edges),
anc AS (SELECT source AS id, 1 AS d FROM e, h WHERE target = h.id AND kind = 'contains')
SELECT DISTINCT * FROM (SELECT 'ancestors' AS section, id, d::VARCHAR AS detail FROM anc
UNION ALL SELECT 'incoming', source, kind FROM e, h WHERE target = h.id AND kind IN ('calls', 'references')
UNION ALL SELECT 'outgoing', target, kind FROM e, h WHERE source = h.id AND kind IN ('calls', 'references')
UNION ALL SELECT 'types', target, kind FROM e, h WHERE source = h.id AND kind IN ('extends', 'implements')
UNION ALL SELECT 'imports', target, kind FROM e, h WHERE source = h.id AND kind = 'imports')""")
def q_focal_context(g):
    return context.focal(g.nodes, g.edges, _hub(g))


@query("g_nodes g_edges", _bm25_sql("g_nodes", "id", SYMBOLS, WORDS, "AND") + """, roots AS (SELECT id FROM ranked),
o AS (SELECT * FROM g_edges WHERE source IN (SELECT id FROM roots)), n AS (SELECT id FROM roots UNION SELECT target FROM o)
SELECT 'nodes' AS metric, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM (SELECT source, target, kind FROM o UNION SELECT source, target, kind FROM g_edges WHERE target IN (SELECT id FROM roots))
UNION ALL SELECT 'files', count(DISTINCT file_path) FROM g_nodes WHERE id IN (SELECT id FROM n)""")
def q_task_context(g):
    return context.stats(*context.around(g.nodes, g.edges, stored(search.bm25(g.nodes, list(search.COLUMNS), WORDS).select("id"), "roots")))


# ---- resolution ----

RES = """, sym AS (SELECT * FROM g_nodes WHERE kind NOT IN ('file', 'import', 'module')), rf AS (SELECT *, row_number() OVER () AS rid FROM g_refs),
mods AS (SELECT regexp_replace(replace(path, '/', '.'), '[.][^.]*$', '') AS module, min(path) AS path FROM g_files GROUP BY 1),
byfile AS (SELECT file_path, name, arg_min(id, struct_pack(l := start_line, i := id)) AS id FROM sym GROUP BY ALL),
imp AS (SELECT i.file_path, i.name, i.id AS iid, regexp_replace(i.qualified_name, '[.][^.]*$', '') AS module, i.qualified_name AS qn FROM g_nodes i WHERE kind = 'import'),
cand AS (SELECT imp.file_path, imp.name, iid, coalesce(b.id, q.id, CASE WHEN m.path IS NOT NULL THEN 'file:' || m.path END) AS target, CASE WHEN b.id IS NOT NULL THEN 1.1 WHEN q.id IS NOT NULL THEN 1.2 ELSE 1.3 END::DOUBLE AS p
  FROM imp LEFT JOIN mods m USING (module) LEFT JOIN byfile b ON b.file_path = m.path AND b.name = imp.name LEFT JOIN (SELECT qualified_name, min(id) AS id FROM sym GROUP BY 1) q ON q.qualified_name = imp.qn),
one AS (SELECT file_path, name, arg_min(target, struct_pack(p := p, i := iid)) AS target, min(p) AS p FROM cand WHERE target IS NOT NULL GROUP BY ALL),
anywhere AS (SELECT name, arg_min(id, struct_pack(h := NOT (is_exported OR NOT starts_with(name, '_')), f := file_path, l := start_line, i := id)) AS id FROM sym GROUP BY name),
c AS (SELECT rid, target, p FROM rf JOIN one ON one.file_path = rf.file_path AND one.name = rf.reference_name
  UNION ALL SELECT rid, byfile.id, 2.0 FROM rf JOIN byfile ON byfile.file_path = rf.file_path AND byfile.name = rf.reference_name
  UNION ALL SELECT rid, 'file:' || mods.path, 3.0 FROM rf JOIN mods ON mods.module = rf.reference_name
  UNION ALL SELECT rid, anywhere.id, 4.0 FROM rf JOIN anywhere ON anywhere.name = rf.reference_name),
best AS (SELECT rid, arg_min(target, p) AS target, min(p) AS priority FROM c GROUP BY rid)"""


def _refs(g: Derived) -> DataFrame:
    return stored(g.refs, "refs").withColumn("ref_id", F.monotonically_increasing_id())


@query("g_files", """, m AS (SELECT regexp_replace(replace(path, '/', '.'), '[.][^.]*$', '') AS module, path FROM g_files)
SELECT module, path FROM m UNION ALL SELECT DISTINCT split_part(module, '.', 1), NULL FROM m""")
def q_res_module_registry(g):
    return resolve.modules(g.files)


@query("g_nodes", "SELECT file_path, name, regexp_replace(qualified_name, '[.][^.]*$', '') AS module, qualified_name, id AS import_id FROM g_nodes WHERE kind = 'import'")
def q_res_import_map(g):
    return resolve.import_map(g.nodes)


@query("g_nodes g_refs", RES + " SELECT from_node_id, reference_name, line, target FROM rf JOIN c USING (rid) WHERE p = 2")
def q_res_same_file(g):
    refs = _refs(g)
    return refs.join(resolve.candidates(refs, g.nodes, g.files).where("priority = 2"), "ref_id").select("from_node_id", "reference_name", "line", "target")


@query("g_nodes g_refs", RES + " SELECT from_node_id, reference_name, line, target, p AS priority FROM rf JOIN c USING (rid) WHERE p < 2")
def q_res_import(g):
    refs = _refs(g)
    return refs.join(resolve.candidates(refs, g.nodes, g.files).where("priority < 2"), "ref_id").select("from_node_id", "reference_name", "line", "target", "priority")


@query("g_nodes g_refs", RES + " SELECT from_node_id, reference_name, line, target FROM rf JOIN c USING (rid) WHERE p = 4")
def q_res_global(g):
    refs = _refs(g)
    return refs.join(resolve.candidates(refs, g.nodes, g.files).where("priority = 4"), "ref_id").select("from_node_id", "reference_name", "line", "target")


@query("g_nodes g_refs", RES + """ SELECT from_node_id AS source, target, CASE reference_kind WHEN 'call' THEN 'calls' WHEN 'imports' THEN 'imports' ELSE 'references' END AS kind, line, 'resolved' AS provenance
FROM rf JOIN best USING (rid) WHERE target IS NOT NULL AND from_node_id <> target""")
def q_res_all(g):
    return resolve.resolved_edges(_refs(g), g.nodes, g.files)


@query("g_nodes", "SELECT 'nowhere_' || pk AS reference_name, (SELECT min(id) FROM g_nodes n WHERE n.qualified_name = s.qualified_name) AS target, 5.0::DOUBLE AS priority FROM g_sym s")
def q_res_candidates(g):
    """References that only their own lists of candidates resolve, in the lists' order."""
    named = g.sym.select("pk", "qualified_name", "file_path", F.col("id").alias("from_node_id"), F.concat(F.lit("nowhere_"), F.col("pk").cast("string")).alias("reference_name"))
    refs = stored(named.withColumn("candidates", F.array(F.lit("no.such.thing"), F.col("qualified_name"))), "refs").withColumn("ref_id", F.col("pk"))
    return refs.join(resolve.resolve(refs, g.nodes, g.files), "ref_id").select("reference_name", "target", "priority")


# ---- extraction ----


def _sources(g: Derived) -> DataFrame:
    """One small Python file for each symbol's file of the derived graph: its classes, functions and imports as text."""
    line = F.when(F.col("kind") == "class", F.concat(F.lit("class "), "name", F.lit(":\n    def run(self):\n        return helper(self)\n"))).when(
        F.col("kind") == "import", F.concat(F.lit("from "), F.regexp_replace("qualified_name", r"\.[^.]*$", ""), F.lit(" import "), "name", F.lit("\n"))
    )
    line = F.coalesce(line, F.concat(F.lit("def "), "name", F.lit("(x):\n    return helper(x)\n")))
    made = g.sym.select("file_path", "pk", line.alias("line")).groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("pk", "line"))).alias("l"))
    return made.select(F.concat("file_path", F.lit(".py")).alias("path"), F.lit("python").alias("language"), F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))


@query("g_sym", """SELECT CASE WHEN kind IN ('class', 'import') THEN kind ELSE 'function' END AS kind, file_path || '.py' AS file_path, count(DISTINCT CASE kind WHEN 'import' THEN qualified_name END) + count(CASE WHEN kind <> 'import' THEN 1 END) AS n FROM g_sym GROUP BY ALL
UNION ALL SELECT 'method', file_path || '.py', count(*) FROM g_sym WHERE kind = 'class' GROUP BY ALL UNION ALL SELECT 'file', path || '.py', 1 FROM (SELECT DISTINCT file_path AS path FROM g_sym)""")
def q_ext_python(g):
    return extract.extract(_sources(g)).where("rec = 'node'").groupBy("kind", "file_path").agg(F.count(F.lit(1)).alias("n"))


@query("g_sym", "SELECT file_path || '.py' AS file_path, qualified_name, name FROM g_sym WHERE kind = 'import' GROUP BY ALL")
def q_ext_imports(g):
    return extract.extract(_sources(g)).where("rec = 'node' AND kind = 'import'").select("file_path", "qualified_name", "name")


@query("g_sym", "SELECT file_path || '.py' AS file_path, 'helper' AS name, count(*) AS n FROM g_sym WHERE kind <> 'import' GROUP BY ALL")
def q_ext_calls(g):
    return extract.extract(_sources(g)).where("rec = 'ref' AND kind = 'call'").groupBy("file_path", "name").agg(F.count(F.lit(1)).alias("n"))


@query("", "SELECT p_partkey AS pk, '/' || replace(p_name, ' ', '/') AS url, 'GET' AS methods, 'view_' || p_partkey AS handler FROM part")
def q_ext_routes(g):
    text = F.concat(F.lit("from flask import Flask\napp = Flask('a')\n@app.route('/"), F.translate("p_name", " ", "/"), F.lit("')\ndef view_"), F.col("p_partkey").cast("string"), F.lit("():\n    return 1\n"))
    src = g.table("part").select(F.col("p_partkey").cast("string").alias("path"), F.lit("python").alias("language"), text.alias("text"))
    rows = stored(extract.extract(src).where("kind IN ('route', 'function_ref')"), "routes")
    route = rows.where("rec = 'node' AND kind = 'route'").select("id", F.col("file_path").cast("long").alias("pk"), F.col("name").alias("url"), F.col("signature").alias("methods"))
    return route.join(rows.where("rec = 'ref' AND kind = 'function_ref'").select(F.col("source").alias("id"), F.col("name").alias("handler")), "id").select("pk", "url", "methods", "handler")


@query("", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS link FROM pages")
def q_ext_page_links(g):
    return extract.page_links(g.table("pages"))


def _made(g: Derived, path, language: str, text, keep: str = "kind IN ('route', 'function_ref')") -> DataFrame:
    """Rows of one made-up source file for each part, those that are asked for."""
    src = g.table("part").select(path.alias("path"), F.lit(language).alias("language"), text.alias("text"))
    return stored(extract.extract(src).where(keep), "made")


PK = lambda: F.col("p_partkey").cast("string")
_pk = lambda: F.split("file_path", "/")[0].cast("long").alias("pk")


@query("", "SELECT p_partkey AS pk, unnest(['Base' || p_partkey % 7, 'mod.Other']) AS base FROM part")
def q_ext_bases(g):
    text = F.concat(F.lit("class A"), PK(), F.lit("(Base"), (F.col("p_partkey") % 7).cast("string"), F.lit(", mod.Other):\n    pass\n"))
    return _made(g, PK(), "python", text, "rec = 'ref' AND kind = 'extends'").select(_pk(), F.col("name").alias("base"))


@query("", """SELECT p_partkey AS pk, x.kind AS kind, x.name || p_partkey AS name FROM part, unnest([{'kind': 'interface', 'name': 'I'}, {'kind': 'enum', 'name': 'E'}, {'kind': 'type_alias', 'name': 'T'}]) AS u(x)
UNION ALL SELECT p_partkey, 'struct', 'S' || p_partkey FROM part""")
def q_ext_types(g):
    ts = F.concat(F.lit("export interface I"), PK(), F.lit(" extends J {}\nenum E"), PK(), F.lit(" { P }\ntype T"), PK(), F.lit(" = string;\n"))
    rust = F.concat(F.lit("pub struct S"), PK(), F.lit(" {\n}\n"))
    keep = "rec = 'node' AND kind <> 'file'"
    both = _made(g, F.concat(PK(), F.lit("/a.ts")), "typescript", ts, keep).unionByName(_made(g, F.concat(PK(), F.lit("/a.rs")), "rust", rust, keep))
    return both.select(_pk(), "kind", "name")


@query("", """SELECT p_partkey AS pk, x.kind AS kind, replace(x.name, '#', CAST(p_partkey AS VARCHAR)) AS name, x.e AS is_exported
FROM part, unnest([{'kind': 'constant', 'name': 'LIMIT_#', 'e': true}, {'kind': 'variable', 'name': 'plain#', 'e': true}, {'kind': 'variable', 'name': '_hidden#', 'e': false}]) AS u(x)""")
def q_ext_variables(g):
    """Module level only: no dunder names, none of classes or functions."""
    text = F.concat(F.lit("LIMIT_"), PK(), F.lit(" = 1\nplain"), PK(), F.lit(" = 2\n__all__ = 3\nclass C:\n    inner = 4\ndef f():\n    local = 5\n_hidden"), PK(), F.lit(" = 6\n"))
    return _made(g, PK(), "python", text, "rec = 'node' AND kind IN ('variable', 'constant')").select(_pk(), "kind", "name", "is_exported")


def _routes(rows: DataFrame) -> DataFrame:
    route = rows.where("rec = 'node' AND kind = 'route'").select("id", _pk(), F.col("name").alias("url"), F.col("signature").alias("methods"))
    return route.join(rows.where("rec = 'ref' AND kind = 'function_ref'").select(F.col("source").alias("id"), F.col("name").alias("handler"), F.col("metadata").alias("framework")), "id").drop("id")


@query("", "SELECT p_partkey AS pk, 'a/' || p_partkey AS url, '' AS methods, 'v' || p_partkey AS handler, 'django' AS framework FROM part UNION ALL SELECT p_partkey, '^d/$', '', 'D' || p_partkey, 'django' FROM part")
def q_ext_routes_urls(g):
    text = F.concat(F.lit("urlpatterns = [path('a/"), PK(), F.lit("', views.v"), PK(), F.lit("), re_path(r'^d/$', D"), PK(), F.lit(".as_view()), path('x/', include('x.urls'))]\n"))
    return _routes(_made(g, F.concat(PK(), F.lit("/urls.py")), "python", text))


@query("", "SELECT p_partkey AS pk, replace(x.url, '#', CAST(p_partkey AS VARCHAR)) AS url, x.methods AS methods, x.handler AS handler, 'fastapi' AS framework FROM part, unnest([{'url': '/g#', 'methods': 'GET', 'handler': 'g'}, {'url': '/m', 'methods': 'PUT,POST', 'handler': 'm'}, {'url': '/d', 'methods': 'GET', 'handler': 'd'}]) AS u(x)")
def q_ext_routes_verbs(g):
    text = F.concat(F.lit("from fastapi import FastAPI\n@app.get('/g"), PK(), F.lit("')\ndef g(): pass\n@app.api_route('/m', methods=['PUT', 'post'])\nasync def m(): pass\n@app.api_route('/d')\ndef d(): pass\n"))
    return _routes(_made(g, F.concat(PK(), F.lit("/api.py")), "python", text))


@query("", "SELECT p_partkey AS pk, '/a' AS url, '' AS methods, 'a' AS handler, 'django' AS framework FROM part UNION ALL SELECT p_partkey, '/b' || p_partkey, 'GET', 'b', 'flask' FROM part")
def q_ext_routes_merged(g):
    """One route of each (url, handler): the first framework's."""
    text = F.concat(F.lit("from flask import Flask\nurlpatterns = [path('/a', views.a)]\n@app.route('/a')\ndef a(): pass\n@app.route('/b"), PK(), F.lit("')\ndef b(): pass\n@app.route('/b"), PK(), F.lit("')\ndef b(): pass\n"))
    return _routes(_made(g, F.concat(PK(), F.lit("/urls.py")), "python", text))


# ---- sync and streams ----

EVEN = "(SELECT path, md5(CAST(count(*) AS VARCHAR)) AS content_hash FROM g_changes WHERE change_type {0} GROUP BY path)"


@query("g_changes", f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM {EVEN.format("<> 'added'")} a FULL JOIN {EVEN.format("<> 'removed'")} b USING (path) WHERE a.content_hash IS DISTINCT FROM b.content_hash""")
def q_str_diff(g):
    side = lambda kind: g.changes.where(F.col("change_type") != kind).groupBy("path").agg(F.md5(F.count(F.lit(1)).cast("string")).alias("content_hash"))
    return mutations.file_changes(side("added"), side("removed"))


LATEST = "SELECT path, max(ts) AS ts, arg_max(change_type, struct_pack(t := ts, e := event_id)) AS change_type, count(*) AS n_changes FROM g_changes GROUP BY path"


@query("g_changes", LATEST)
def q_str_latest_state(g):
    return changes.latest(g.changes)


def _feed(g: Derived) -> DataFrame:
    """The change feed as a stream over the events."""
    events = g.spark.readStream.schema(g.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(g.folder)
    kind = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed").otherwise("modified")
    path = F.concat(F.lit("proj_"), F.col("user_id").cast("string"), F.lit("/f"), (F.col("event_id") % 20).cast("string"), F.lit(".py"))
    return events.select("event_id", "ts", path.alias("path"), kind.alias("change_type"))


@query("g_changes", LATEST)
def q_str_stream_latest(g):
    got = changes.drain(changes.newest_stream(_feed(g)))
    return got.groupBy("path").agg(F.max_by(F.struct("ts", "change_type", "n_changes"), "batch").alias("m")).select("path", "m.*")


DEBOUNCE = """, o AS (SELECT split_part(path, '/', 1) AS project, path, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY split_part(path, '/', 1) ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS s FROM g_changes),
i AS (SELECT *, sum(s) OVER (PARTITION BY project ORDER BY ts, event_id) AS burst FROM o)
SELECT project, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_changes, count(DISTINCT path) AS n_paths FROM i GROUP BY project, burst"""


@query("g_changes", DEBOUNCE)
def q_str_debounce(g):
    """With an hour as the gap, as the feed is sparse."""
    return changes.debounced(g.changes, 3600)


@query("g_nodes g_refs", RES + """ SELECT from_node_id AS source, target, CASE reference_kind WHEN 'call' THEN 'calls' WHEN 'imports' THEN 'imports' ELSE 'references' END AS kind, line
FROM rf JOIN best USING (rid) WHERE target IS NOT NULL AND from_node_id <> target""")
def q_str_incremental_equals_full(g):
    """One language's files leave and come back: the edges are those of a full build."""
    py = g.files.where("language = 'python'")
    nodes, _, refs = mutations.delete_files(g.nodes, g.edges, g.refs, py)
    back = lambda df: lookups.refs_where(df, paths=py)
    nodes, refs = nodes.unionByName(g.nodes.join(py.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(*nodes.columns)), refs.unionByName(back(g.refs).select(*refs.columns))
    refs = stored(refs, "refs").withColumn("ref_id", F.monotonically_increasing_id())
    return resolve.resolved_edges(refs, stored(nodes, "nodes"), g.files).drop("provenance")


def queries() -> dict[str, Callable]:
    return {name: lambda spark, sf_dir, f=f: f(Derived(spark, sf_dir)) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
