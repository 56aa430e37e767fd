import pytest

from sparkloom.sources import extract as X
from sparkloom.sources.extract import parse


def nodes(rows, kind=None):
    return {(r["kind"], r["name"]) for r in rows if r["rec"] == "node" and (kind is None or r["kind"] == kind)}


def refs(rows, kind):
    return {r["name"] for r in rows if r["rec"] == "ref" and r["kind"] == kind}


PY = '''"""doc"""
import os.path as osp
from lib.tools import add, mul
MAX_SIZE = 3
x, y = 1, 2

class Base: pass

class Shape(Base):
    """A shape."""
    side = 1
    @staticmethod
    def make(n):
        return add(n, osp.join("a", "b"))
    async def area(self):
        def inner(): return mul(1, 2)
        return inner()

@decorated(1)
def run(): return Shape.make(3).area()
'''


def test_python_tree():
    rows = parse("a/b.py", "python", PY)
    assert {("class", "Base"), ("class", "Shape"), ("method", "make"), ("method", "area"), ("function", "inner"), ("function", "run"), ("constant", "MAX_SIZE"), ("variable", "x"), ("variable", "y"), ("import", "osp"), ("import", "add"), ("import", "mul"), ("file", "b.py")} == nodes(rows)
    by = {r["id"]: r for r in rows if r["rec"] == "node"}
    assert by["method:a/b.py::Shape.make"]["is_static"] and by["method:a/b.py::Shape.area"]["is_async"]
    assert by["class:a/b.py::Shape"]["docstring"] == "A shape." and by["import:a/b.py::lib.tools.add"]["qualified_name"] == "lib.tools.add"
    assert refs(rows, "extends") == {"Base"} and refs(rows, "decorates") == {"staticmethod", "decorated"} and refs(rows, "imports") == {"os.path", "lib.tools"}
    assert {"add", "osp.join", "mul", "inner", "Shape.make"} <= refs(rows, "call")
    ends = {r["target"] for r in rows if r["rec"] == "edge"} | {r["source"] for r in rows if r["rec"] == "edge"}
    assert ends == set(by)


def test_broken_python_falls_back_to_lines():
    rows = parse("x.py", "python", "class A(B):\n    def f(self):\n        g(1)\n\ndef h(:\n")
    assert {("class", "A"), ("method", "f"), ("function", "h")} <= nodes(rows) and refs(rows, "extends") == {"B"} and "g" in refs(rows, "call")


@pytest.mark.parametrize(("path", "lang", "text", "want", "rel", "calls"), [
    ("a.ts", "typescript", "import {x} from './lib';\nexport interface I extends J {}\nexport class A extends B implements I {\n  go(n: number) {\n    return help(n);\n  }\n}\nenum E { P }\ntype T = string;\nconst f = (a) => run(a);\nfunction g() {}\n", {("interface", "I"), ("class", "A"), ("method", "go"), ("enum", "E"), ("type_alias", "T"), ("function", "f"), ("function", "g"), ("import", "lib")}, {"J", "B", "I"}, {"help", "run"}),
    ("a.go", "go", 'package a\nimport "fmt"\ntype S struct {\n}\ntype R interface {\n}\nfunc (s *S) Go(n int) int {\n\treturn help(n)\n}\nfunc main() {\n\tfmt.Println(1)\n}\n', {("struct", "S"), ("interface", "R"), ("method", "Go"), ("function", "main"), ("import", "fmt")}, set(), {"help", "fmt.Println"}),
    ("A.java", "java", "import java.util.List;\npublic class A extends B implements C, D {\n  public int go(int n) {\n    return help(n);\n  }\n}\ninterface I {}\nenum E { X }\n", {("class", "A"), ("method", "go"), ("interface", "I"), ("enum", "E"), ("import", "List")}, {"B", "C", "D"}, {"help"}),
    ("a.rs", "rust", "use std::fmt;\npub struct S {\n}\ntrait T {\n}\nimpl T for S {\n    pub fn go(&self) -> i32 {\n        help(1)\n    }\n}\nenum E { A }\nfn main() {\n    go();\n}\n", {("struct", "S"), ("interface", "T"), ("method", "go"), ("enum", "E"), ("function", "main"), ("import", "fmt")}, {"T"}, {"help", "go"}),
    ("a.c", "c", '#include <stdio.h>\nstruct P {\n  int x;\n};\nint add(int a, int b) {\n  return help(a);\n}\n', {("struct", "P"), ("function", "add"), ("import", "h")}, set(), {"help"}),
    ("a.cpp", "cpp", "class A : public B {\n};\nint A::go(int n) {\n  return help(n);\n}\n", {("class", "A"), ("function", "go")}, {"B"}, {"help"}),
    ("a.rb", "ruby", "require 'json'\nclass A < B\n  def go\n    help(1)\n  end\nend\n", {("class", "A"), ("method", "go"), ("import", "json")}, {"B"}, {"help"}),
    ("a.swift", "swift", "import UIKit\npublic class A: B {\n  func go() {\n    help()\n  }\n  init() {\n  }\n}\nprotocol P {\n}\n", {("class", "A"), ("method", "go"), ("method", "init"), ("interface", "P"), ("import", "UIKit")}, {"B"}, {"help"}),
    ("a.kt", "kotlin", "import a.b.C\nclass A : B {\n  fun go() {\n    help()\n  }\n}\ninterface I {\n}\n", {("class", "A"), ("method", "go"), ("interface", "I"), ("import", "C")}, {"B"}, {"help"}),
    ("a.dart", "dart", "import 'x.dart';\nclass A extends B {\n  int go(int n) {\n    return help(n);\n  }\n}\n", {("class", "A"), ("method", "go"), ("import", "dart")}, {"B"}, {"help"}),
    ("a.scala", "scala", "import a.b\nclass A extends B {\n  def go(n: Int) = {\n    help(n)\n  }\n}\ntrait T\n", {("class", "A"), ("method", "go"), ("interface", "T"), ("import", "b")}, {"B"}, {"help"}),
    ("a.lua", "lua", "local j = require('json')\nfunction M.go(n)\n  return help(n)\nend\n", {("method", "go"), ("import", "json")}, set(), {"help"}),
    ("a.php", "php", "<?php\nuse A\\B;\nclass C extends D implements E {\n  public function go($n) {\n    return help($n);\n  }\n}\n", {("class", "C"), ("method", "go"), ("import", "B")}, {"D", "E"}, {"help"}),
])
def test_languages_by_their_rules(path, lang, text, want, rel, calls):
    rows = parse(path, lang, text)
    assert want <= nodes(rows)
    assert refs(rows, "extends") | refs(rows, "implements") == rel
    assert calls <= refs(rows, "call")


def test_broken_python_keeps_decorators_and_docstrings():
    text = 'class A:\n    """What A is."""\n    @staticmethod\n    @reg.add(1)\n    def f(x):\n        \'\'\'Does f.\n        Well.\'\'\'\n        g(1)\n\ndef h(:\n'
    rows = parse("x.py", "python", text)
    by = {r["name"]: r for r in rows if r["rec"] == "node"}
    assert by["A"]["docstring"] == "What A is." and by["f"]["docstring"] == "Does f.\nWell." and by["f"]["is_static"] and by["h"]["docstring"] is None
    assert refs(rows, "decorates") == {"staticmethod", "reg.add"}


def test_other_languages_give_the_file_alone():
    assert nodes(parse("a.yaml", "yaml", "a: 1\n")) == {("file", "a.yaml")}
    assert nodes(parse("e.py", "python", "")) == {("file", "e.py")} == {("file", "e.py")}
    assert nodes(parse("e.js", "javascript", "")) == {("file", "e.js")}


def test_own_rules_can_be_added(spark):
    X.register("nix", X.LanguageSpec([r"^def (?P<name>\w+)"], comment="#", blocks="indent"))
    try:
        df = spark.createDataFrame([("a.nix", "nix", "def go\n"), ("b.py", "python", None)], "path string, language string, text string")
        assert {r.name for r in X.extract(df).where("rec = 'node'").collect()} == {"a.nix", "go"}
    finally:
        del X.SPECS["nix"]


def test_routes():
    flask = "from flask import Flask\n@app.route('/a', methods=['GET', \"post\"])\n@login\ndef a(): pass\n@app.put('/b')\n\nasync def b(): pass\n@app.route('/a')\ndef a(): pass\n@app.get('/none')\nx = 1\n"
    assert X.routes("v.py", flask) == [("flask", "/a", "GET,POST", "a", 2), ("flask", "/b", "PUT", "b", 5)]
    fast = "from fastapi import APIRouter\n@r.get('/x')\nasync def x(): pass\n@r.api_route('/y', methods=['TRACE'])\ndef y(): pass\n@r.trace('/z')\ndef z(): pass\n"
    assert [r[:4] for r in X.routes("f.py", fast)] == [("fastapi", "/x", "GET", "x"), ("fastapi", "/y", "TRACE", "y"), ("fastapi", "/z", "TRACE", "z")]
    django = "urlpatterns = [path('i/', views.index), re_path(r'^d/$', D.as_view(), name='d'), path('x/', include('x.urls')), url(r'u', u)]\n"
    assert [r[:4] for r in X.routes("app/urls.py", django)] == [("django", "i/", "", "index"), ("django", "^d/$", "", "D"), ("django", "u", "", "u")]
    assert X.routes("app/views.py", django) == []


def test_unicode_and_many_functions():
    rows = parse("u.py", "python", "def größe(): pass\n" + "".join(f"def f{i}(): return f{i - 1}()\n" for i in range(502)))
    assert len(nodes(rows, "function")) == 503 and ("function", "größe") in nodes(rows)


def test_files_are_spread_and_rows_leave_in_chunks(spark, monkeypatch):
    """Before, a table read as one task was parsed by one, and the rows of a batch of files were held together."""
    text = "".join(f"class C{i}(B):\n    def run(self):\n        return helper(self)\n" for i in range(40)) + "@app.route('/x')\ndef f(): pass\n"
    df = spark.createDataFrame([(f"a{i}.py", "python", text) for i in range(8)], "path string, language string, text string").coalesce(1)
    assert X.extract(df).rdd.getNumPartitions() > 4
    whole = parse("a.py", "python", text)
    monkeypatch.setattr(X, "LARGE", 100)
    large = X.rows_of("a.py", "python", text)
    assert not isinstance(large, list) and list(large) == whole and {r["kind"] for r in whole} >= {"route", "function_ref", "class", "method", "call", "extends"}
    assert sum(1 for _ in X.extract(df).collect()) == 8 * len(whole)
    deep = "x = " + "-" * 900 + "1\n"
    assert parse("a.py", "python", "def f(): pass\n" + deep) == [*X.rows_of("a.py", "python", "def f(): pass\n" + deep)]


def test_lines_of_routes():
    text = "".join(f"@app.get('/{i}')\ndef f{i}(): pass\n" for i in range(30))
    assert [r[4] for r in X.routes("a.py", text)] == [1 + 2 * i for i in range(30)]
