import io
import json

import pytest
from pyspark.sql import functions as F

from sparkloom import cli, server
from sparkloom.api import ProjectGraph
from sparkloom.errors import LoomError, NotInitialized, UnsafeRoot
from sparkloom.sources import scan
from sparkloom.store import GraphStore


def write(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_py", ".py").replace("_js", ".js")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write(root, utils_py="def greet(n):\n    return n\n\ndef add(a, b):\n    return a + b\n", app_py="from utils import greet, add\n\ndef run():\n    return greet(1)\n\ndef compute():\n    return add(1, 2)\n", pkg__algo_a_py="def go():\n    return 1\n", pkg__algo_b_py="def go():\n    return 2\n", main_py="from pkg.algo_a import go\n\ndef start():\n    return go()\n")
    return root


def edges(g, kind="calls"):
    return {(r.source.split("::")[-1], r.target.split("::")[-1]) for r in g.edges.where(F.col("kind") == kind).collect()}


def test_index_and_sync(spark, tree, tmp_path):
    g = ProjectGraph.init(spark, tree, f"{tmp_path}/graph")
    assert g.index_all() == {"added": 5, "modified": 0, "removed": 0, "unchanged": 0}
    assert {("run", "greet"), ("compute", "add"), ("start", "go")} <= edges(g)
    assert g.edges.where("kind = 'calls' AND source LIKE '%start'").first().target == "function:pkg/algo_a.py::go"
    assert g.sync() == {"added": 0, "modified": 0, "removed": 0, "unchanged": 5}
    version = g.store.metadata()["number"]
    # a changed, a new and a removed file; callers in unchanged files keep their edges
    write(tree, utils_py="def greet(n):\n    return n + 1\n\ndef add(a, b):\n    return b + a\n", more_py="from app import run\n\ndef again():\n    return run()\n")
    (tree / "pkg/algo_b.py").unlink()
    assert {r.path: r.change for r in g.changed_files().collect()}.keys() >= {"more.py", "pkg/algo_b.py"}
    assert g.sync() == {"added": 1, "modified": 1, "removed": 1, "unchanged": 3}
    assert g.store.metadata()["number"] == version + 1
    assert {("run", "greet"), ("compute", "add"), ("again", "run")} <= edges(g)
    incremental = [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in (g.nodes, g.edges)]
    g.sync(rebuild=True)
    assert [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in (g.nodes, g.edges)] == incremental
    g.store.vacuum()
    assert g.nodes.count() and not g.is_stale()

    run = g.id_of("run")
    assert {r.id for r in g.callees(run).collect()} >= {"function:utils.py::greet"}
    assert {r.id.split("::")[-1] for r in g.callers(g.id_of("greet"), 2).collect()} >= {"run", "again"}
    assert [r.id.split("::")[-1] for r in g.find_path(g.id_of("again"), g.id_of("greet"), ["calls"]).orderBy("position").collect()] == ["again", "run", "greet"]
    assert g.impact(run).count() > 2 and g.impact_risk(run).count() > 2
    assert g.search("greet").first().name == "greet"
    assert {r.name for r in g.exported_symbols("utils.py").collect()} == {"greet", "add"}
    assert {r.depends_on for r in g.file_dependencies("more.py").collect()} >= {"app.py", "utils.py"}
    n, e, blocks = g.task_context("greet")
    assert n.count() and e.count() and any("def greet" in r.block for r in blocks.collect())
    assert g.unresolved.count() >= 0 and g.stats().count() == 4 and g.last_indexed_at()

    out = io.StringIO()
    args = ["--root", str(tree), "--folder", f"{tmp_path}/graph", "--json"]
    for command in (["status"], ["query", "greet"], ["query", "--kind", "function"], ["explore", "greet"], ["callers", "greet"], ["callees", "run"], ["impact", "greet"], ["affected", "utils.py"], ["node", "greet"], ["files"], ["files", "--dirs"], ["sync"], ["install"], ["unlock"]):
        assert cli.main(args + command, spark, out) == 0, command
    assert "function:utils.py::greet" in out.getvalue()
    assert cli.main([*args, "node", "no such symbol at all"], spark, out) == 1

    lines = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "greet"}}}, {"id": 4, "method": "tools/call", "params": {"name": "callers", "arguments": {}}}, {"id": 5, "method": "nope"}, {"id": 6, "method": "ping"}, {"id": 7, "method": "tools/call", "params": {"name": "impact", "arguments": {"name": "greet"}}}]
    said = io.StringIO()
    server.serve(g, io.StringIO("\n".join(map(json.dumps, lines)) + "\nnot json\n"), said)
    got = {m["id"]: m for m in map(json.loads, said.getvalue().splitlines())}
    assert len(got[2]["result"]["tools"]) == 8 and "greet" in got[3]["result"]["content"][0]["text"]
    assert got[4]["result"]["isError"] and got[5]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700 and "risk" in got[7]["result"]["content"][0]["text"]

    g.uninitialize()
    assert not ProjectGraph.is_initialized(spark, tree, f"{tmp_path}/graph")
    with pytest.raises(NotInitialized):
        ProjectGraph.open(spark, tree, f"{tmp_path}/graph")


def test_counts_of_a_larger_sync(spark, tmp_path):
    root = tmp_path / "many"
    for i in range(30):
        write(root, **{f"m{i}_py": f"def f{i}():\n    return {i}\n"})
    g = ProjectGraph.init(spark, root, f"{tmp_path}/g")
    assert g.index_all()["added"] == 30
    for i in range(30, 50):
        write(root, **{f"m{i}_py": f"def f{i}():\n    return f{i - 1}()\n"})
    for i in range(10):
        write(root, **{f"m{i}_py": f"def f{i}():\n    return {i} + 1000\n"})
    for i in range(25, 30):
        (root / f"m{i}.py").unlink()
    assert g.sync() == {"added": 20, "modified": 10, "removed": 5, "unchanged": 15}
    assert g.files.count() == 45


def test_scan_rules(spark, tmp_path):
    root = tmp_path / "t"
    for name in ("a.py", "b.txt", ".hidden.py", "node_modules/x.js", ".git/c.py", "src/d.go", "src/e.bak", "src/f_test.go", "big.py", "keep/g.py", "keep/h.py", "a b+c.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    (root / "big.py").write_text("#" * (scan.MOST_BYTES + 1))
    seen = lambda **o: {r.path for r in scan.scan(spark, str(root), scan.ScanOptions(**o)).collect()}
    assert seen() == {"a.py", "src/d.go", "src/f_test.go", "big.py", "keep/g.py", "keep/h.py", "a b+c.py"}
    assert seen(exclude=["*_test.*"], include=["src/*"]) == {"src/d.go"}
    assert "b.txt" in seen(extensions={".txt": "text"})
    assert seen(ignore_file="# c\n*.go\nkeep/\n!src/d.go\n/a.py\n") == {"src/d.go", "big.py", "a b+c.py"}
    assert "a.py" in seen(ignore_file="*.py", respect_ignore=False)
    rows = {r.path: r for r in scan.read_sources(spark, str(root)).collect()}
    assert rows["big.py"].problem == "file_too_large" and rows["big.py"].text is None and rows["a.py"].text == "x = 1\n"
    assert scan.ScanOptions.from_json('{"include": ["a"], "include_ignored": true}').respect_ignore is False
    with pytest.raises(ValueError, match="unknown"):
        scan.ScanOptions.from_json('{"x": 1}')
    names = spark.createDataFrame([("package.json", '{"name": "@my/coolTool"}'), ("pyproject.toml", '[project]\nname = "data-loom"\n'), (".", "root_dir")], "path string, text string")
    assert {r.token for r in scan.name_tokens(names).collect()} == {"my", "cool", "tool", "data", "loom", "root", "dir"}


def test_unsafe_root(spark):
    for bad in ("/", "file:///"):
        with pytest.raises(UnsafeRoot):
            GraphStore.create(spark, bad)
    assert issubclass(UnsafeRoot, LoomError)


def test_named_files_values_and_reconciliation(spark, tree, tmp_path):
    g = ProjectGraph.init(spark, tree, f"{tmp_path}/graph")
    g.index_all()
    write(tree, utils_py="def greet(n):\n    return n\n\ndef add(a, b):\n    return a\n", extra_py="def extra():\n    return 1\n", other_py="def other():\n    return 1\n")
    (tree / "pkg/algo_b.py").unlink()
    assert g.index_files(["utils.py", "extra.py", "pkg/algo_b.py", "main.py"]) == {"added": 1, "modified": 1, "removed": 1, "unchanged": 1}
    assert g.index_file("utils.py") == {"added": 0, "modified": 0, "removed": 0, "unchanged": 1}
    names = {r.name for r in g.nodes.select("name").collect()}
    assert {"extra", "greet", "start"} <= names and "other" not in names
    assert ("run", "greet") in edges(g)
    assert g.reconcile()["added"] == 1 and g.reconcile() == {"added": 0, "modified": 0, "removed": 0}
    g.set_value("owner", "me")
    assert g.value("owner") == "me" and g.value("none") is None
    before = [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in (g.nodes, g.edges)]
    g.store.compact()
    assert [sorted(map(repr, t.select(*sorted(t.columns)).collect())) for t in (g.nodes, g.edges)] == before
    assert g.value("owner") == "me" and len(g.store._markers()) == 1
    assert {r.section for r in g.neighbourhood(g.id_of("run")).collect()} >= {"incoming", "outgoing", "callees"}
    assert {r.depends_on for r in g.file_dependencies("app.py").collect()} == {"utils.py"}


def test_large_files_are_never_read(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.py").write_text("y = 1\n" * 100)
    got = {r.path: r for r in scan.read_sources(spark, str(tmp_path), most_bytes=50).collect()}
    assert got["a.py"].problem is None and got["a.py"].text == "x = 1\n" and len(got["a.py"].content_hash) == 64
    assert got["b.py"].problem == "file_too_large" and got["b.py"].text is None and got["b.py"].size == 600
    only = scan.read_sources(spark, str(tmp_path), only=["a.py", "none.py"]).collect()
    assert [r.path for r in only] == ["a.py"]
    assert scan.read_sources(spark, str(tmp_path), only=["none.py"]).count() == 0
