import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import aggregates, graph, mutations, resolve

KINDS = ["calls", "references", "imports", "extends", "contains"]


def random_graph(seed, n=40, m=70):
    r = random.Random(seed)
    return [(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}", r.choice(KINDS), r.randint(1, 9)) for _ in range(m)]


def as_edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, kind string, line int")


def neighbours(rows, way, kinds):
    adj = {}
    for s, t, k, _ in rows:
        if s != t and (kinds is None or k in kinds):
            if way in ("out", "both"):
                adj.setdefault(s, set()).add(t)
            if way in ("in", "both"):
                adj.setdefault(t, set()).add(s)
    return adj


def bfs(adj, start, most=None):
    depth, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        if most is not None and depth[x] >= most:
            continue
        for y in adj.get(x, ()):
            if y not in depth:
                depth[y] = depth[x] + 1
                todo.append(y)
    return depth


@pytest.mark.parametrize(("seed", "way", "most", "kinds"), [(1, "out", None, None), (2, "in", 2, ["calls", "references"]), (3, "both", 3, None)])
def test_traversal(spark, seed, way, most, kinds):
    rows = random_graph(seed)
    start = rows[0][0]
    got = {r.id: r.depth for r in graph.traverse(as_edges(spark, rows), start, most, way, kinds).collect()}
    assert got == bfs(neighbours(rows, way, kinds), start, most)


def test_many_levels(spark):
    rows = [(f"n{i:02}", f"n{i + 1:02}", "calls", 1) for i in range(20)]
    got = {r.id: r.depth for r in graph.traverse(as_edges(spark, rows), "n00").collect()}
    assert got == {f"n{i:02}": i for i in range(21)}


def test_depth_first(spark):
    rows = [("a", "c", "calls", 1), ("a", "b", "calls", 1), ("b", "d", "calls", 1), ("d", "a", "calls", 1), ("c", "d", "calls", 1)]
    got = [(r.id, r.depth) for r in graph.depth_first(as_edges(spark, rows), "a", 9).orderBy("position").collect()]
    assert got == [("a", 0), ("b", 1), ("d", 2), ("c", 1)]
    alone = graph.depth_first(as_edges(spark, rows), "zz", 9).collect()
    assert [(r.id, r.depth) for r in alone] == [("zz", 0)]


def test_paths(spark):
    rows = random_graph(5, 25, 60)
    start = rows[0][0]
    adj = neighbours(rows, "out", None)
    depth = bfs(adj, start, 19)
    for r in graph.paths_from(as_edges(spark, rows), start).collect():
        assert r.length == depth[r.id] == len(r.path) - 1 and r.path[0] == start and r.path[-1] == r.id
        assert all(b in adj[a] for a, b in zip(r.path, r.path[1:]))
    assert graph.find_path(as_edges(spark, rows), start, "nowhere").count() == 0
    assert [(r.position, r.id) for r in graph.find_path(as_edges(spark, rows), start, start).collect()] == [(0, start)]


@pytest.mark.parametrize("seed", [7, 8])
def test_strong_components(spark, seed):
    rows = [(s, t, "calls", n) for s, t, _, n in random_graph(seed, 30, 50)]
    adj = neighbours(rows, "out", None)
    reach = {x: set(bfs(adj, x)) for x in {s for s, *_ in rows} | {t for _, t, *_ in rows}}
    want = {}
    for x in reach:
        own = {y for y in reach[x] if x in reach[y]}
        if len(own) > 1:
            want[x] = min(own)
    assert {r.id: r.component for r in graph.strong_components(as_edges(spark, rows)).collect()} == want


def test_no_cycles(spark):
    assert graph.strong_components(as_edges(spark, [("a", "b", "calls", 1)])).count() == 0


def test_cycles_by_length(spark):
    rows = [(a, b, "calls", 1) for a, b in ("ab", "ba", "bc", "ca", "cd", "da")]
    assert [r.cycle for r in graph.simple_cycles(as_edges(spark, rows), 2).collect()] == [["a", "b"]]
    assert [r.cycle for r in graph.simple_cycles(as_edges(spark, rows), 3).collect()] == [["a", "b", "c"]]
    assert [r.cycle for r in graph.simple_cycles(as_edges(spark, rows), 4).collect()] == [["a", "b", "c", "d"]]


NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean"


def as_nodes(spark, *rows):
    return spark.createDataFrame([(f"{k}:{p}::{n}", k, n, q or f"{p}::{n}", p, "python", line, line, x) for k, n, q, p, line, x in rows], NODE)


def test_resolution_in_order(spark):
    nodes = as_nodes(
        spark,
        ("function", "run", None, "a/algo_a.py", 1, True), ("function", "run", None, "a/algo_b.py", 1, True), ("import", "run", "a.algo_b.run", "main.py", 1, False),
        ("function", "own", None, "main.py", 5, True), ("function", "own", None, "a/algo_a.py", 2, True), ("function", "_hidden", None, "z.py", 1, False),
        ("function", "only", None, "z.py", 2, False), ("function", "_only", None, "a/algo_a.py", 9, False), ("import", "json", "json", "main.py", 2, False),
        ("file", "algo_a.py", "a/algo_a.py", "a/algo_a.py", 1, False), ("file", "main.py", "main.py", "main.py", 1, False),
    )
    files = spark.createDataFrame([("a/algo_a.py",), ("a/algo_b.py",), ("main.py",), ("z.py",), ("pkg/__init__.py",)], "path string")
    names = ["run", "own", "only", "a.algo_a", "a.algo_b", "json", "nothing", "given"]
    refs = spark.createDataFrame([(i, f"function:main.py::f{i}", n, "call", i, "main.py", ["nope", "z.py::_hidden"] if n == "given" else None) for i, n in enumerate(names)], "ref_id long, from_node_id string, reference_name string, reference_kind string, line int, file_path string, candidates array<string>")
    got = {names[r.ref_id]: (r.target, r.priority) for r in resolve.resolve(refs, nodes, files).collect()}
    assert got == {
        "run": ("function:a/algo_b.py::run", 1.1), "own": ("function:main.py::own", 2.0), "only": ("function:z.py::only", 4.0),
        "a.algo_a": ("file:a/algo_a.py::algo_a.py", 3.0), "given": ("function:z.py::_hidden", 5.0),
    }
    mods = {(r.module, r.path) for r in resolve.modules(files).collect()}
    assert mods == {("a.algo_a", "a/algo_a.py"), ("a.algo_b", "a/algo_b.py"), ("main", "main.py"), ("z", "z.py"), ("pkg", "pkg/__init__.py"), ("a", None)}


def test_callers_by_edge_and_by_name(spark):
    nodes = as_nodes(spark, ("function", "f", None, "a.py", 1, True), ("import", "f", "a.f", "b.py", 1, False), ("function", "g", None, "b.py", 2, True), ("method", "__len__", None, "a.py", 3, True), ("function", "h", None, "c.py", 1, True))
    edges = as_edges(spark, [("function:b.py::g", "function:a.py::f", "calls", 3), ("function:a.py::f", "function:a.py::f", "calls", 1)])
    refs = spark.createDataFrame([("function:c.py::h", "x.f", "call", 1, "c.py"), ("function:c.py::h", "__len__", "call", 2, "c.py"), ("function:a.py::f", "s.__len__", "call", 2, "a.py"), ("function:b.py::g", "f", "call", 9, "b.py")], "from_node_id string, reference_name string, reference_kind string, line int, file_path string")
    got = {tuple(r) for r in graph.callers(nodes, edges, refs).collect()}
    both = {("function:b.py::g", "edge"), ("function:c.py::h", "name")}
    assert got == {(t, c, v) for t in ("function:a.py::f", "import:b.py::f") for c, v in both} | {("method:a.py::__len__", "function:a.py::f", "name")}
    callees = {tuple(r) for r in graph.callees(nodes, edges, refs).collect()}
    assert callees == {("function:b.py::g", "function:a.py::f", "edge"), ("function:b.py::g", "import:b.py::f", "name"), ("function:c.py::h", "method:a.py::__len__", "name")}


def test_mutations(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("y", 5, "old")], "id string, seq int, v string")
    b = spark.createDataFrame([("x", 2, "new"), ("y", 5, "new"), ("z", 1, "new")], "id string, seq int, v string")
    assert {(r.id, r.v) for r in mutations.upsert(a, b).collect()} == {("x", "new"), ("y", "new"), ("z", "new")}
    assert {(r.id, r.v) for r in mutations.update(a, b.where("id = 'x'").select("id", "v")).collect()} == {("x", "new"), ("y", "old")}
    edges = spark.createDataFrame([("a", "b", "calls", None), ("a", "b", "calls", None), ("a", "b", "calls", 1), ("a", "q", "calls", 1)], "source string, target string, kind string, line int")
    nodes = spark.createDataFrame([("a", "f"), ("b", "f")], "id string, file_path string")
    assert mutations.insert_edges(edges.limit(0), edges, nodes).count() == 2
    refs = spark.createDataFrame([("a", "f", "n")], "from_node_id string, file_path string, reference_name string")
    assert [df.count() for df in mutations.delete_files(nodes, edges, refs, spark.createDataFrame([("f",)], "path string"))] == [0, 0, 0]


def test_directories_collapse(spark):
    files = spark.createDataFrame([(f"a/f{i}.py", "python") for i in range(11)] + [("b.go", "go")], "path string, language string")
    got = {r.dir: (r.n_files, r.names) for r in aggregates.directories(files).collect()}
    assert got == {"a": (11, None), ".": (1, ["b.go"])}


def test_risk(spark):
    rows = [("h", f"x{i}", "calls", 1) for i in range(10)] + [("m", "x0", "calls", 1), ("m", "x1", "calls", 1), ("m", "x2", "calls", 1)]
    got = {r.id: r.risk for r in graph.risk(as_edges(spark, rows)).where(F.col("id").isin("h", "m", "x9")).collect()}
    assert got == {"h": "high", "m": "medium", "x9": "low"}


def named_graph(spark, seed):
    """Nodes, edges and references in which few names stand for many symbols, special methods and imports among them."""
    r = random.Random(seed)
    names = ["f", "g", "h", "__len__"]
    nodes = as_nodes(spark, *((r.choice(["function", "import", "method"]), n, None, f"{p}{n}.py", i, True) for p in "abcdefgh" for i, n in enumerate(names)))
    ids = [x.id for x in nodes.collect()]
    edges = as_edges(spark, [(r.choice(ids), r.choice(ids), r.choice(["calls", "references", "imports"]), i) for i in range(60)])
    file = {x.id: x.file_path for x in nodes.collect()}
    at = [r.choice(ids) for _ in range(80)]
    refs = spark.createDataFrame([(i, r.choice(["", "", "x."]) + r.choice(names), "call", 1, file[i]) for i in at], "from_node_id string, reference_name string, reference_kind string, line int, file_path string")
    return nodes, edges, refs


def brute_pairs(nodes, edges, refs):
    nodes, edges, refs = ([*df.collect()] for df in (nodes, edges, refs))
    direct = {(e.source, e.target) for e in edges if e.kind in ("calls", "references")}
    named, plain = set(), set()
    for x in refs:
        for n in nodes:
            if n.name in (x.reference_name, x.reference_name.split(".")[-1]) and (n.name != "__len__" or n.file_path == x.file_path):
                named.add((x.from_node_id, n.id))
            if n.name == x.reference_name:
                plain.add((x.from_node_id, n.id))
    meant = {n.id: min(((d.file_path, d.start_line, d.id) for d in nodes if n.kind == "import" and d.kind != "import" and d.name == n.name and d.file_path != n.file_path), default=(n.id,))[-1] for n in nodes}
    callers = {(n.id, a, "edge" if (a, b) in direct else "name") for n in nodes for a, b in direct | named if b == meant[n.id] and a not in (n.id, b)}
    return callers, {(a, b, "edge" if (a, b) in direct else "name") for a, b in direct | plain if a != b}


@pytest.mark.parametrize("seed", [1, 2])
def test_common_names(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "LEFT_BLOCK", 3)
    monkeypatch.setattr(graph, "RIGHT_BLOCK", 2)
    tables = named_graph(spark, seed)
    want = brute_pairs(*tables)
    few = tables[0].select("id").orderBy("id").limit(9)
    some = {x.id for x in few.collect()}
    for found, asked in ((graph.callers, want[0]), (graph.callees, want[1])):
        assert sorted(map(tuple, found(*tables).collect())) == sorted(asked)
        assert sorted(map(tuple, found(*tables, few).collect())) == sorted(x for x in asked if x[0] in some)


def test_pairs_of_a_name_are_not_shuffled(spark):
    """Before, all pairs went through an exchange, which filled the disks."""
    for found in (graph.callers, graph.callees):
        plan = found(*named_graph(spark, 3))._jdf.queryExecution().executedPlan().toString()
        above = plan.split("Generate explode(rs")[0]
        assert above != plan and "Exchange hashpartitioning" not in above.split("BroadcastExchange")[0]


@pytest.mark.parametrize("seed", [4])
def test_counts_without_pairs(spark, seed):
    tables = named_graph(spark, seed)
    for counts, want in zip((graph.caller_counts, graph.callee_counts), brute_pairs(*tables)):
        assert {r.id: r[1] for r in counts(*tables).collect()} == dict(Counter(x[0] for x in want))
