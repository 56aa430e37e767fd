"""Graph operators as joins over whole frontiers: traversal, paths, cycles, metrics, dead code, dependencies, callers.

Every level of a traversal is one join for all starts together. Levels are written to the shared folder, so that lineage
stays short and a lost executor costs one level at most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import text as fn
from sparkloom.schema import CALLABLE
from sparkloom.session import small, spread, stored

USES = ("calls", "references")
#: Hops of a label between two writes, where the levels don't matter.
HOPS = 3
#: Levels after which what has been seen is written as one table.
COMPACT = 8
#: Ids that are asked for by value, which a scan of a sorted table uses to skip what can't hold them; more are joined.
POINTS = 256
#: Rows of a name that are paired as one block.
LEFT_BLOCK, RIGHT_BLOCK = 2048, 8192


def adjacency(edges: DataFrame, direction: str = "out", kinds: Sequence[str] | None = None) -> DataFrame:
    """Distinct (a, b): from a one gets to b in one hop. direction is out, in or both."""
    return _hops(edges, edges, direction, kinds).distinct()


def _hops(edges: DataFrame, edges_in: DataFrame, direction: str, kinds: Sequence[str] | None) -> DataFrame:
    """(a, b) of every edge, by source from edges and by target from edges_in."""
    ok = F.col("kind").isin(*kinds) if kinds else F.lit(True)
    out = edges.where(ok).select(F.col("source").alias("a"), F.col("target").alias("b"))
    back = edges_in.where(ok).select(F.col("target").alias("a"), F.col("source").alias("b"))
    return (out if direction == "out" else back if direction == "in" else out.unionByName(back)).where("a <> b")


def at_ids(df: DataFrame, column: str, ids: DataFrame, count: int | None = None) -> DataFrame:
    """Rows of df whose column is among the id column of ids: by value if they are few, else by a join."""
    count = ids.count() if count is None else count
    if count <= POINTS:
        return df.where(F.col(column).isin([r.id for r in ids.collect()]))
    return df.join(small(ids.select(F.col("id").alias("_at")).distinct(), 64), F.col(column) == F.col("_at"), "left_semi")


def reach_by(step: Callable[[DataFrame, int], DataFrame], starts: DataFrame, max_depth: int | None = None, parents: bool = False) -> DataFrame:
    """(root, id, depth[, parent]): breadth-first from every (root, id) of starts, depth the least number of hops.

    step gives (a, b), the hops from each id of a table with as many rows as its second argument says, and maybe others.
    All roots advance together, one join a level, until a level is empty or max_depth is reached. parents: the least id of
    the level before that leads to a node.
    """
    extra = [F.lit(None).cast("string").alias("parent")] if parents else []
    level = stored(starts.select("root", "id").distinct().select("root", "id", F.lit(0).alias("depth"), *extra), "level")
    seen, depth, n = level, 0, level.count()
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        # the level is known to be small or the join shuffles
        hop = (F.broadcast(level) if n * 128 <= 32 << 20 else level).join(step(level.select("id"), n), F.col("id") == F.col("a"))
        key = ["root", F.col("b").alias("id")]
        new = hop.groupBy(*key).agg(F.min("id").alias("parent")) if parents else hop.select(*key).distinct()
        new = new.join(seen.select("root", "id"), ["root", "id"], "left_anti")
        level = stored(new.select("root", "id", F.lit(depth).alias("depth"), *(["parent"] if parents else [])), "level")
        n = level.count()
        if n:
            seen = seen.unionByName(level)
        if depth % COMPACT == 0:
            seen = stored(seen, "seen")
    return seen


def reach(adj: DataFrame, starts: DataFrame, max_depth: int | None = None, parents: bool = False) -> DataFrame:
    """reach_by over an adjacency, written once as it is read for every level."""
    adj = stored(adj, "adjacency")
    return reach_by(lambda ids, n: adj, starts, max_depth, parents)


def closure(adj: DataFrame, starts: DataFrame) -> DataFrame:
    """(root, id) of everything that (root, id) of starts lead to, themselves included; HOPS hops between two writes."""
    now, n = stored(starts.select("root", "id").distinct(), "closure"), -1
    while (count := now.count()) != n:
        nxt, n = now, count
        for _ in range(HOPS):
            nxt = nxt.unionByName(nxt.join(adj, F.col("id") == F.col("a")).select("root", F.col("b").alias("id"))).distinct()
        now = stored(nxt, "closure")
    return now


def from_one(spark, node: str) -> DataFrame:
    return spark.createDataFrame([(node, node)], "root string, id string")


def traverse(edges: DataFrame, start: str, max_depth: int | None = None, direction: str = "out", kinds: Sequence[str] | None = None, edges_in: DataFrame | None = None) -> DataFrame:
    """(id, depth) from one start, itself at depth 0. edges_in are the same edges sorted by target, where there is such a copy:
    each level then reads what stands at its ids. Otherwise an adjacency is made once if there is no bound on the depth."""
    one = from_one(edges.sparkSession, start)
    if edges_in is None and max_depth is None:
        return reach(adjacency(edges, direction, kinds), one).select("id", "depth")
    hops = _hops(edges, edges if edges_in is None else edges_in, direction, kinds)
    return reach_by(lambda ids, n: at_ids(hops, "a", ids, n) if n <= POINTS else hops, one, max_depth).select("id", "depth")


def touched_edges(edges: DataFrame, visited: DataFrame, max_depth: int | None, direction: str = "both", kinds: Sequence[str] | None = None) -> DataFrame:
    """Edges met while the visited nodes above max_depth are expanded: once for each end that is."""
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    inner = visited if max_depth is None else visited.where(F.col("depth") < max_depth)
    ends = {"out": ["source"], "in": ["target"], "both": ["source", "target"]}[direction]
    found = [edges.join(inner.select(F.col("id").alias(e)), e, "left_semi").select(*edges.columns) for e in ends]
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def depth_first(edges: DataFrame, start: str, max_depth: int, direction: str = "out", kinds: Sequence[str] | None = None) -> DataFrame:
    """(id, depth, position) in pre-order, neighbours by id, each at the depth of its first visit.

    The order is sequential by nature: only the part of the graph within max_depth hops goes to one task.
    """
    adj = adjacency(edges, direction, kinds)
    near = stored(reach(adj, from_one(edges.sparkSession, start), max_depth).select("id"), "near")
    inside = adj.join(near.select(F.col("id").alias("a")), "a", "left_semi").join(near.select(F.col("id").alias("b")), "b", "left_semi")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        nexts = pdf.sort_values("b").groupby("a")["b"].apply(list).to_dict()
        seen, out, todo = set(), [], [(start, 0)]
        while todo:
            node, depth = todo.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((node, depth, len(out)))
            if depth < max_depth:
                todo += [(x, depth + 1) for x in reversed(nexts.get(node, [])) if x not in seen]
        return pd.DataFrame(out, columns=["id", "depth", "position"])

    rows = inside.unionByName(edges.sparkSession.createDataFrame([(start, None)], "a string, b string"))
    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda pdf: walk(pdf.dropna()), "id string, depth int, position int")


def paths_from(edges: DataFrame, start: str, max_nodes: int = 20, kinds: Sequence[str] | None = None) -> DataFrame:
    """(id, length, path): a shortest path along edges to every node within max_nodes nodes; of equals the one whose
    parents, from the end backwards, have the least ids. The start has length 0."""
    tree = stored(reach(adjacency(edges, "out", kinds), from_one(edges.sparkSession, start), max_nodes - 1, parents=True).select("id", "depth", "parent"), "tree")
    last = tree.agg(F.max("depth")).first()[0] or 0
    done = at = tree.where("depth = 0").select("id", F.col("depth").alias("length"), F.array("id").alias("path"))
    for depth in range(1, last + 1):
        before = at.select(F.col("id").alias("parent"), "path")
        at = tree.where(F.col("depth") == depth).join(before, "parent").select("id", F.col("depth").alias("length"), F.concat("path", F.array("id")).alias("path"))
        done = done.unionByName(at)
    return done


def find_path(edges: DataFrame, start: str, end: str, max_nodes: int = 20, kinds: Sequence[str] | None = None) -> DataFrame:
    """(position, id) along a shortest path; no rows if there is none."""
    return paths_from(edges, start, max_nodes, kinds).where(F.col("id") == end).select(F.posexplode("path").alias("position", "id"))


def hierarchy(edges: DataFrame) -> DataFrame:
    """(id, relative, kind, direction) of every node with a type above or below it, one hop."""
    types = edges.where(F.col("kind").isin("extends", "implements"))
    up = types.select(F.col("source").alias("id"), F.col("target").alias("relative"), "kind", F.lit("up").alias("direction"))
    down = types.select(F.col("target").alias("id"), F.col("source").alias("relative"), "kind", F.lit("down").alias("direction"))
    return up.unionByName(down).distinct()


def _trimmed(adj: DataFrame) -> DataFrame:
    """Edges between nodes that have both a way in and a way out, again and again."""
    n = adj.count()
    while n:
        ends = adj.select(F.col("a").alias("id")).distinct().intersect(adj.select(F.col("b").alias("id")).distinct())
        adj = stored(adj.join(ends.withColumnRenamed("id", "a"), "a", "left_semi").join(ends.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"), "trimmed")
        now = adj.count()
        if now == n:
            break
        n = now
    return adj


def strong_components(edges: DataFrame, kinds: Sequence[str] = ("imports", "calls")) -> DataFrame:
    """(id, component): nodes on cycles of at least two nodes, named by the least id of their strongly connected component.

    Trimming drops what is on no cycle. Then the least id that reaches a node colours it; the nodes of a colour that reach
    the node of that name are a component; they leave the graph and the rest goes on.
    """
    adj = _trimmed(stored(adjacency(edges, "out", kinds), "adjacency"))
    done = None
    while not adj.isEmpty():
        colour = stored(adj.select(F.col("a").alias("id")).union(adj.select("b")).distinct().select("id", F.col("id").alias("colour")), "colour")
        while True:
            nxt = colour
            for _ in range(HOPS):
                got = adj.join(nxt, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("colour").alias("_c"))
                nxt = nxt.join(got, "id", "left").select("id", F.least("colour", "_c").alias("colour"))
            nxt = stored(nxt, "colour")
            moved = not nxt.join(colour, ["id", "colour"], "left_anti").isEmpty()
            colour = nxt
            if not moved:
                break
        same = adj.join(colour.select(F.col("id").alias("a"), F.col("colour").alias("_ca")), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("_cb")), "b").where("_ca = _cb")
        roots = colour.where("id = colour").select(F.col("id").alias("root"), "id")
        back = stored(same.select(F.col("b").alias("a"), F.col("a").alias("b")), "back")
        found = closure(back, roots).select("id", F.col("root").alias("component"))
        done = found if done is None else done.unionByName(found)
        rest = adj.join(found.select(F.col("id").alias("a")), "a", "left_anti").join(found.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b")
        adj = _trimmed(stored(rest, "rest"))
    if done is None:
        return edges.sparkSession.createDataFrame([], "id string, component string")
    done = stored(done, "components")
    return done.join(done.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("id", "component")


def simple_cycles(edges: DataFrame, length: int, kinds: Sequence[str] = ("imports", "calls")) -> DataFrame:
    """(cycle): the distinct simple cycles of so many nodes, as arrays that begin with their least id."""
    adj = stored(adjacency(edges, "out", kinds), "adjacency")
    at = adj.where("a < b").select(F.array("a", "b").alias("cycle"), F.col("b").alias("end"))
    step = adj.select(F.col("a").alias("end"), F.col("b").alias("_next"))
    for _ in range(length - 2):
        at = at.join(step, "end").where((F.col("_next") > F.col("cycle")[0]) & ~F.array_contains("cycle", F.col("_next"))).select(F.concat("cycle", F.array("_next")).alias("cycle"), F.col("_next").alias("end"))
    return at.join(step, "end").where(F.col("_next") == F.col("cycle")[0]).select("cycle")


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees of every node: all edges, and uses (calls and references) alone."""
    use = F.col("kind").isin(*USES)
    both = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), use.cast("int").alias("fo"), F.lit(0).alias("fi"))
    both = both.unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("fo"), use.cast("int").alias("fi")))
    sums = both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("fo").alias("fan_out"), F.sum("fi").alias("fan_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("id").join(sums, "id", "left").select("id", *map(zero, ("out_degree", "in_degree", "fan_out", "fan_in")))


def call_depths(nodes: DataFrame, edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, call_depth) of every node, or of the ids asked for: the greatest number of hops from which it is called.

    For all nodes that is as many rows on the way as pairs of nodes that lead to each other."""
    nodes = nodes if ids is None else at_ids(nodes, "id", ids)
    starts = nodes.select(F.col("id").alias("root"), "id")
    called = edges.where("kind = 'calls'").select(F.col("target").alias("id")).distinct()
    found = reach(adjacency(edges, "in", ["calls"]), starts.join(called, "id", "left_semi"))
    deep = found.groupBy(F.col("root").alias("id")).agg(F.max("depth").alias("call_depth"))
    return nodes.select("id").join(deep, "id", "left").select("id", F.coalesce("call_depth", F.lit(0)).alias("call_depth"))


def exported_ids(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids that are flagged as exported or are the target of an exports edge."""
    return nodes.where("is_exported").select("id").union(edges.where("kind = 'exports'").select("target")).distinct()


def exported_symbols(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(exported_ids(nodes, edges), "id", "left_semi").where("kind <> 'file'").select("file_path", "id", "name", "kind")


def dead_code(nodes: DataFrame, edges: DataFrame, min_fan_in: int = 0) -> DataFrame:
    """(bucket, id): unexported_functions, unreferenced callables and classes, unused_imports. Buckets overlap."""
    hidden = nodes.join(exported_ids(nodes, edges), "id", "left_anti")
    uses = edges.where(F.col("kind").isin("calls", "references", "imports", "extends", "implements")).groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    one = hidden.where(F.col("kind").isin(*CALLABLE)).select(F.lit("unexported_functions").alias("bucket"), "id")
    two = hidden.where(F.col("kind").isin(*CALLABLE, "class")).join(uses, "id", "left").where(F.coalesce("n", F.lit(0)) <= min_fan_in).select(F.lit("unreferenced").alias("bucket"), "id")
    seen = edges.where("kind = 'references'").select(F.col("target").alias("id"))
    three = nodes.where("kind = 'import'").join(seen, "id", "left_anti").select(F.lit("unused_imports").alias("bucket"), "id")
    return one.unionByName(two).unionByName(three)


def with_files(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the files of both ends."""
    at = nodes.select("id", "file_path")
    return edges.join(at.select(F.col("id").alias("source"), F.col("file_path").alias("source_file")), "source").join(at.select(F.col("id").alias("target"), F.col("file_path").alias("target_file")), "target")


def file_dependencies(nodes: DataFrame, edges: DataFrame, kinds: Sequence[str] = ("imports", "references"), files: DataFrame | None = None) -> DataFrame:
    """(file, depends_on, n_edges) between different files; files (path): of these only."""
    edges = edges.where(F.col("kind").isin(*kinds))
    if files is None:
        found = with_files(edges, nodes)
    else:
        own = stored(at_ids(nodes, "file_path", files.select(F.col("path").alias("id"))).select("id", "file_path"), "own")
        found = with_files(at_ids(edges, "source", own.select("id")), nodes)
    return found.where("source_file <> target_file").groupBy(F.col("source_file").alias("file"), F.col("target_file").alias("depends_on")).agg(F.count(F.lit(1)).alias("n_edges"))


def file_closure(nodes: DataFrame, edges: DataFrame, levels: int | None = None, files: DataFrame | None = None) -> DataFrame:
    """(file, depends_on, level): dependencies through other files, all levels by default; files (path): of these only, level
    by level over the files that are met."""
    if files is None:
        direct = stored(file_dependencies(nodes, edges).select(F.col("file").alias("a"), F.col("depends_on").alias("b")), "files")
        found = reach(direct, direct.select(F.col("a").alias("root"), F.col("a").alias("id")).distinct(), levels)
    else:
        step = lambda ids, n: file_dependencies(nodes, edges, files=ids.select(F.col("id").alias("path"))).select(F.col("file").alias("a"), F.col("depends_on").alias("b"))
        found = reach_by(step, files.select(F.col("path").alias("root"), F.col("path").alias("id")), levels)
    return found.where("depth > 0").select(F.col("root").alias("file"), F.col("id").alias("depends_on"), F.col("depth").alias("level"))


def file_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, dependent, kind): symbols of other files that use one of the file, once for each edge."""
    found = with_files(edges.where("kind <> 'contains'"), nodes).where("source_file <> target_file")
    return found.select(F.col("target_file").alias("file"), F.col("source").alias("dependent"), "kind")


def affected_tests(nodes: DataFrame, edges: DataFrame, files: DataFrame, depth: int = 2) -> DataFrame:
    """(path, test): test files within so many hops, either way, of a symbol of each changed file."""
    starts = nodes.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("file_path").alias("root"), "id")
    near = reach(adjacency(edges, "both"), starts, depth)
    name = F.regexp_replace(fn.base_name(F.col("file_path")), r"\.[^.]*$", "")
    tests = nodes.where(name.endswith("_test") | name.startswith("test_")).select("id", F.col("file_path").alias("test"))
    return near.join(tests, "id").select(F.col("root").alias("path"), "test").distinct()


def risk(subgraph: DataFrame, high: int = 10, medium: int = 3) -> DataFrame:
    """(id, degree, risk) over the ends of the edges of a subgraph."""
    ends = subgraph.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return ends.select("id", "degree", F.when(F.col("degree") >= high, "high").when(F.col("degree") >= medium, "medium").otherwise("low").alias("risk"))


# ---- callers and callees: resolved edges, and names that aren't resolved yet ----


def definition_of_imports(nodes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, definition) of every import node, or of those asked for, with a namesake in another file: the first by file, line and id.

    Definitions are first cut to the best two files of each name, so a common name doesn't multiply."""
    imports = nodes.where("kind = 'import'").select("id", "name", "file_path")
    defs = nodes.where(~F.col("kind").isin("import", "file"))
    if ids is not None:
        imports = stored(at_ids(imports, "id", ids), "imports")
        defs = at_ids(defs, "name", imports.select(F.col("name").alias("id")).distinct())
    per_file = defs.groupBy("name", F.col("file_path").alias("_f")).agg(F.min(F.struct("start_line", "id")).alias("_d"))
    best = per_file.withColumn("_n", F.row_number().over(W.partitionBy("name").orderBy("_f"))).where("_n <= 2")
    return imports.join(best, "name").where("_f <> file_path").groupBy("id").agg(F.min_by("_d.id", "_f").alias("definition"))


def _named_refs(refs: DataFrame) -> DataFrame:
    """References by every name that they may mean: the whole, and the part after the last dot."""
    names = F.array_distinct(F.array(F.col("reference_name"), fn.last_part(F.col("reference_name"))))
    return refs.select("from_node_id", "file_path", "line", F.explode(names).alias("_name"))


def _paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r) of every row of left (name, l) with every row of right (name, r) that has its name.

    The rows of a name are cut into blocks and each block of one side meets each of the other, in a task of its own; what
    is shuffled are the blocks, never the pairs. So a name of many rows on both sides needs time in proportion to its pairs,
    but neither memory nor disk."""
    left, right = stored(left.where("name IS NOT NULL"), "left"), stored(right.where("name IS NOT NULL"), "right")
    count = lambda df, col, most: df.groupBy("name").agg(F.ceil(F.count(F.lit(1)) / most).alias(col))
    blocks = stored(count(left, "_nl", LEFT_BLOCK).join(count(right, "_nr", RIGHT_BLOCK), "name"), "blocks")
    hint, tasks = small(blocks, 128), spread(left.sparkSession)

    def cut(df: DataFrame, col: str, own: str, other: str) -> DataFrame:
        """One row for each block of df and each block of the other side."""
        mine, theirs = f"_b{own}", f"_b{other}"
        numbered = df.join(hint, "name").withColumn(mine, F.pmod(F.xxhash64(col), F.col(f"_n{own}")))
        lists = numbered.groupBy("name", mine, f"_n{other}").agg(F.collect_list(col).alias(f"{col}s"))
        return lists.select("name", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{other}") - 1)).alias(theirs), f"{col}s").repartition(tasks, "name", "_bl", "_br")

    met = cut(left, "l", "l", "r").join(cut(right, "r", "r", "l"), ["name", "_bl", "_br"])
    return met.select(F.explode("ls").alias("l"), "rs").select("l", F.explode("rs").alias("r"))


def callers(nodes: DataFrame, edges: DataFrame, refs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(target, caller, via) of every node, or of the ids asked for, via edge or name, an edge being preferred. An import's
    callers are its definition's. edges are best those sorted by target if ids are given.

    By name: a reference that has the target's name, whole or after the last dot; a special method's only within its file.
    The pairs of callers by name are made where they are returned, see _paired(); an edge's are taken out of them before.
    """
    asked, direct, named, special = _caller_parts(nodes, edges, refs, ids)
    known = direct.join(asked.select("meant", "name").distinct(), "meant").groupBy("name", "caller").agg(F.collect_set("meant").alias("known"))
    known = known.withColumnRenamed("caller", "from_node_id")
    left = named.join(known, ["name", "from_node_id"], "left").select("name", F.struct(F.col("from_node_id").alias("caller"), F.coalesce("known", F.array().cast("array<string>")).alias("known")).alias("l"))
    right = asked.where(~F.col("name").isin(*fn.SPECIAL_METHODS)).select("name", F.struct("target", "meant").alias("r"))
    by_name = _paired(left, right).where(~F.array_contains("l.known", F.col("r.meant"))).select("r.target", "r.meant", "l.caller", F.lit("name").alias("via"))
    rest = direct.withColumn("via", F.lit("edge")).unionByName(special.join(direct, ["meant", "caller"], "left_anti").withColumn("via", F.lit("name")))
    found = asked.select("target", "meant").join(rest, "meant").select("target", "meant", "caller", "via").unionByName(by_name)
    return found.where("caller <> target AND caller <> meant").select("target", "caller", "via")


def _caller_parts(nodes: DataFrame, edges: DataFrame, refs: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """asked (target, meant, name), direct (meant, caller), named (name, from_node_id) and special (meant, caller), all
    distinct and of the ids asked for: whose callers a target has, by edge, by a name that isn't special, and by one that is."""
    symbols = nodes.where("kind <> 'file'").select("id", "name", "file_path")
    chosen = symbols if ids is None else at_ids(symbols, "id", ids)
    asked = chosen.join(definition_of_imports(nodes, ids), "id", "left").select(F.col("id").alias("target"), F.coalesce("definition", "id").alias("meant"))
    direct = edges.where(F.col("kind").isin(*USES))
    if ids is not None:
        asked = stored(asked, "asked")
        wanted = stored(asked.select(F.col("meant").alias("id")).distinct(), "wanted")
        n = wanted.count()
        direct, symbols = at_ids(direct, "target", wanted, n), at_ids(symbols, "id", wanted, n)
        symbols = small(stored(symbols, "symbols"), 128)
    direct = stored(direct.select(F.col("target").alias("meant"), F.col("source").alias("caller")).distinct(), "direct")
    asked = stored(asked.join(symbols.select(F.col("id").alias("meant"), "name").distinct(), "meant").select("target", "meant", "name"), "asked")
    refs = _named_refs(refs).select("from_node_id", "file_path", F.col("_name").alias("name"))
    if ids is not None:
        refs = refs.join(small(stored(asked.select("name").distinct(), "names"), 64), "name", "left_semi")
    odd = F.col("name").isin(*fn.SPECIAL_METHODS)
    named = stored(refs.where(~odd).select("name", "from_node_id").distinct(), "named")
    special = refs.where(odd).join(symbols.where(odd).select(F.col("id").alias("meant"), "name", "file_path"), ["name", "file_path"])
    return asked, direct, named, stored(special.select("meant", F.col("from_node_id").alias("caller")).distinct(), "special")


def caller_counts(nodes: DataFrame, edges: DataFrame, refs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, n_callers): the number of rows that callers() has of each target with any, counted without making them."""
    asked, direct, named, special = _caller_parts(nodes, edges, refs, ids)
    meant = stored(asked.select("meant", "name").distinct(), "meant")
    per_name = small(stored(named.groupBy("name").agg(F.count("from_node_id").alias("_n")), "per_name"), 64)
    # by edge or by a special name, but not by a name as such
    rest = direct.unionByName(special).distinct().where("caller IS NOT NULL").join(meant, "meant")
    rest = rest.join(named.withColumnRenamed("from_node_id", "caller"), ["name", "caller"], "left_anti").groupBy("meant").agg(F.count(F.lit(1)).alias("_m"))
    # the target itself, or what it means, among them
    selves = asked.select("target", F.col("meant").alias("self"), "meant", "name").unionByName(asked.where("target <> meant").select("target", F.col("target").alias("self"), "meant", "name"))
    pairs = selves.join(direct.unionByName(special).distinct().withColumnRenamed("caller", "self"), ["meant", "self"], "left_semi").select("target", "self")
    pairs = pairs.unionByName(selves.join(named.withColumnRenamed("from_node_id", "self"), ["name", "self"], "left_semi").select("target", "self")).distinct()
    own = pairs.groupBy("target").agg(F.count(F.lit(1)).alias("_own"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    got = asked.join(per_name, "name", "left").join(rest, "meant", "left").join(own, "target", "left")
    return got.groupBy(F.col("target").alias("id")).agg(F.sum(zero("_n") + zero("_m") - zero("_own")).alias("n_callers")).where("n_callers > 0")


def _callee_parts(nodes: DataFrame, edges: DataFrame, refs: DataFrame, ids: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """direct (source, callee), plain (source, name), both distinct and of the ids asked for, and symbols (callee, name)."""
    direct, plain = edges.where(F.col("kind").isin(*USES)), refs.where(~F.col("reference_name").contains("."))
    if ids is not None:
        n = ids.count()
        direct, plain = at_ids(direct, "source", ids, n), at_ids(plain, "from_node_id", ids, n)
    direct = stored(direct.select("source", F.col("target").alias("callee")).where("source <> callee").distinct(), "direct")
    plain = stored(plain.select(F.col("from_node_id").alias("source"), F.col("reference_name").alias("name")).distinct(), "plain")
    symbols = nodes.where("kind <> 'file'").select(F.col("id").alias("callee"), "name").distinct()
    if ids is not None:
        symbols = symbols.join(small(stored(plain.select("name").distinct(), "names"), 64), "name", "left_semi").select("callee", "name")
    return direct, plain, symbols


def callees(nodes: DataFrame, edges: DataFrame, refs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(source, callee, via): the other way round; by name for references without a dot."""
    direct, plain, symbols = _callee_parts(nodes, edges, refs, ids)
    known = direct.join(symbols, "callee").groupBy("source", "name").agg(F.collect_set("callee").alias("known"))
    left = plain.join(known, ["source", "name"], "left").select("name", F.struct("source", F.coalesce("known", F.array().cast("array<string>")).alias("known")).alias("l"))
    named = _paired(left, symbols.select("name", F.struct("callee").alias("r"))).where(~F.array_contains("l.known", F.col("r.callee")))
    return direct.withColumn("via", F.lit("edge")).unionByName(named.select("l.source", "r.callee", F.lit("name").alias("via")).where("source <> callee"))


def callee_counts(nodes: DataFrame, edges: DataFrame, refs: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(id, n_callees): the number of rows that callees() has of each source with any, counted without making them."""
    direct, plain, symbols = _callee_parts(nodes, edges, refs, ids)
    per_name = small(stored(symbols.groupBy("name").agg(F.count("callee").alias("_n")), "per_name"), 64)
    by_name = plain.join(per_name, "name").select("source", "_n")
    own = plain.join(symbols.withColumnRenamed("callee", "source"), ["source", "name"], "left_semi").select("source", F.lit(-1).cast("long").alias("_n"))
    named = direct.join(symbols, "callee").join(plain, ["source", "name"], "left_semi").select("source", F.lit(-1).cast("long").alias("_n"))
    edge = direct.select("source", F.lit(1).cast("long").alias("_n"))
    return by_name.unionByName(own).unionByName(named).unionByName(edge).groupBy(F.col("source").alias("id")).agg(F.sum("_n").alias("n_callees")).where("n_callees > 0")
