"""Command line: sparkloom <command> [--root DIR] [--json] ..."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.api import ProjectGraph
from sparkloom.errors import LoomError
from sparkloom.operators import aggregates, lookups


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkloom", description=__doc__)
    p.add_argument("--root", default=".")
    p.add_argument("--folder", help="where the graph is kept")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, about: str, depth: int | None = None, limit: int | None = None):
        c = sub.add_parser(name, help=about)
        for a in args:
            c.add_argument(a.rstrip("*"), **({"nargs": "*"} if a.endswith("*") else {}))
        if depth:
            c.add_argument("--depth", type=int, default=depth)
        if limit:
            c.add_argument("--limit", type=int, default=limit)
        return c

    command("init", about="make a graph and index the tree")
    command("uninit", about="delete the graph")
    command("index", about="index the tree").add_argument("--force", action="store_true")
    command("sync", about="take in what has changed")
    command("status", about="counts and state")
    q = command("query", "words*", about="search symbols", limit=20)
    q.add_argument("--kind", action="append", default=[])
    q.add_argument("--lang", action="append", default=[])
    q.add_argument("--path", action="append", default=[])
    q.add_argument("--mode", default="text", choices=["text", "exact", "substring"])
    command("explore", "words*", about="search with callers and callees", limit=10)
    command("callers", "name", about="who calls a symbol", depth=1)
    command("callees", "name", about="whom a symbol calls", depth=1)
    command("impact", "name", about="what a change may touch, by risk", depth=3)
    command("affected", "paths*", about="tests near changed files", depth=2)
    command("node", "name", about="one symbol and its surroundings")
    f = command("files", about="indexed files", limit=100)
    f.add_argument("--prefix", default="")
    f.add_argument("--ext", action="append", default=[])
    f.add_argument("--dirs", action="store_true")
    command("install", about="print a client's settings for serve")
    command("serve", about="answer JSON-RPC on standard input")
    command("unlock", about="nothing is locked: a version is written whole or not at all")
    return p


def answer(g: ProjectGraph, a: argparse.Namespace) -> DataFrame | dict:
    """The result of a command that has an open graph."""
    if a.command in ("index", "sync"):
        return g.sync(rebuild=getattr(a, "force", False))
    if a.command == "status":
        return g.stats().unionByName(aggregates.counts_by(g.nodes, "kind").select(F.concat(F.lit("kind "), "kind").alias("metric"), "n").orderBy(F.desc("n"), "metric"))
    if a.command == "query":
        text = " ".join(a.words)
        if not text and a.kind:
            return lookups.by_kind(g.nodes, a.kind[0]).limit(a.limit)
        return g.search(text, a.limit, a.mode, kinds=a.kind, languages=a.lang, paths=a.path).select("id", "kind", "name", "file_path", "start_line", "score")
    if a.command == "explore":
        return g.explore(" ".join(a.words), a.limit)
    if a.command in ("callers", "callees"):
        return getattr(g, a.command)(g.id_of(a.name), a.depth)
    if a.command == "impact":
        return g.impact_risk(g.id_of(a.name), a.depth)
    if a.command == "affected":
        return g.affected_tests(a.paths, a.depth)
    if a.command == "node":
        return g.context(g.id_of(a.name))
    if a.command == "files":
        return aggregates.directories(g.files) if a.dirs else lookups.list_files(g.files, a.prefix, a.ext, a.limit)
    raise LoomError(f"no command {a.command}")


def shown(got: DataFrame | dict, as_json: bool) -> str:
    rows = [got] if isinstance(got, dict) else [r.asDict(True) for r in got.collect()]  # results for display
    if as_json:
        return json.dumps(rows, ensure_ascii=False, default=str)
    return "\n".join("  ".join(f"{k}={v}" for k, v in r.items()) for r in rows) or "nothing found"


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    if a.command == "install":
        print(json.dumps({"command": "sparkloom", "args": ["--root", a.root, "serve"]}), file=out)
        return 0
    if a.command == "unlock":
        return 0
    spark = spark or SparkSession.builder.appName("sparkloom").config("spark.ui.enabled", "false").getOrCreate()
    try:
        if a.command == "init":
            print(shown(ProjectGraph.init(spark, a.root, a.folder).index_all(), a.json), file=out)
            return 0
        g = ProjectGraph.open(spark, a.root, a.folder)
        if a.command == "uninit":
            g.uninitialize()
        elif a.command == "serve":
            from sparkloom.server import serve

            serve(g, sys.stdin, out)
        else:
            print(shown(answer(g, a), a.json), file=out)
    except LoomError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
