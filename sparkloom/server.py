"""JSON-RPC tools over lines of text: initialize, tools/list, tools/call and ping."""

from __future__ import annotations

import json
import sys
from argparse import Namespace
from typing import TextIO

from py4j.protocol import Py4JJavaError

from sparkloom.api import ProjectGraph
from sparkloom.cli import answer, shown
from sparkloom.errors import LoomError

_TEXT, _INT, _LIST = {"type": "string"}, {"type": "integer"}, {"type": "array", "items": {"type": "string"}}
#: Tool: (what it does, its arguments, those that must be given).
TOOLS = {
    "search": ("Symbols by words, kind, language and path", {"query": _TEXT, "kind": _LIST, "lang": _LIST, "path": _LIST, "mode": _TEXT, "limit": _INT}, ["query"]),
    "explore": ("Symbols with how many call them and they call", {"query": _TEXT, "limit": _INT}, ["query"]),
    "node": ("One symbol's surroundings", {"name": _TEXT}, ["name"]),
    "callers": ("Who uses a symbol", {"name": _TEXT, "depth": _INT}, ["name"]),
    "callees": ("What a symbol uses", {"name": _TEXT, "depth": _INT}, ["name"]),
    "impact": ("What a change may touch, by risk", {"name": _TEXT, "depth": _INT}, ["name"]),
    "status": ("Counts of the graph", {}, []),
    "files": ("Indexed files", {"prefix": _TEXT, "ext": _LIST, "limit": _INT}, []),
}
_USUAL = {"kind": [], "lang": [], "path": [], "mode": "text", "limit": 20, "depth": 1, "prefix": "", "ext": [], "dirs": False}


def call(g: ProjectGraph, tool: str, given: dict) -> str:
    if tool not in TOOLS:
        raise LoomError(f"no tool {tool}")
    if missing := [k for k in TOOLS[tool][2] if k not in given]:
        raise LoomError(f"{tool} needs {', '.join(missing)}")
    command = "query" if tool == "search" else tool
    args = _USUAL | ({"depth": 3} if tool == "impact" else {}) | ({"limit": 100} if tool == "files" else {}) | given
    return shown(answer(g, Namespace(command=command, words=str(given.get("query", "")).split(), **args)), True)


def reply(g: ProjectGraph, message: dict) -> dict | None:
    """The answer to one message, none for a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    out = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        try:
            g.reconcile()
        except (LoomError, Py4JJavaError) as e:  # the graph as it is still answers
            print(f"not brought up to date: {e}", file=sys.stderr)
        return out | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "sparkloom", "version": "1"}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}}
    if method == "tools/call":
        try:
            return out | {"result": {"content": [{"type": "text", "text": call(g, params.get("name"), params.get("arguments") or {})}]}}
        except LoomError as e:
            return out | {"result": {"isError": True, "content": [{"type": "text", "text": str(e)}]}}
    return out | {"error": {"code": -32601, "message": f"no method {method}"}}


def serve(g: ProjectGraph, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            got = reply(g, json.loads(line))
        except json.JSONDecodeError:
            got = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if got is not None:
            print(json.dumps(got, ensure_ascii=False), file=out, flush=True)
