"""Files to nodes, edges and references, as one map-side table function.

Python is parsed with its own syntax tree and, where that fails, by the line rules that serve the other languages. Those
are declared in one LanguageSpec each; register() adds more. Every row of the result is tagged node, edge or ref.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.schema import node_id
from sparkloom.session import spread

ROW = (
    "rec string, id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, "
    "docstring string, signature string, is_exported boolean, is_async boolean, is_static boolean, source string, target string, line int, metadata string"
)
COLUMNS = [x.split()[0] for x in ROW.split(", ")]
_EMPTY = dict.fromkeys(COLUMNS)


@dataclass
class LanguageSpec:
    """Line rules of a language. Each pattern has a group `name`; a class pattern may have `bases` (extends) and `ifaces`.

    blocks tells how a body ends: braces, indent or end (a closing keyword). Functions inside a class are methods.
    """

    functions: list[str]
    classes: dict[str, str] = field(default_factory=dict)  # pattern to kind
    imports: list[str] = field(default_factory=list)
    variables: list[str] = field(default_factory=list)
    comment: str = "//"
    blocks: str = "braces"
    receiver: str = ""  # a function's group that names its class
    exported: str = r"^(?!_)"  # over the name
    exported_line: str = ""  # over the line, if that decides
    keywords: frozenset[str] = frozenset("if for while switch catch return function sizeof new elif else except match with do until unless and or not in is lambda print def class".split())


_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_MODS = r"^\s*(?:(?:public|private|protected|internal|static|final|abstract|override|open|export|default|async|suspend|inline|sealed|data|virtual|mutating|case|implicit|external|factory|const|pub(?:\([a-z]+\))?|unsafe|extern|fileprivate|readonly|declare)\s+)*"
_JS = LanguageSpec(
    functions=[_MODS + r"function\s*\*?\s*" + _NAME + r"\s*[<(]", r"^\s*(?:export\s+)?(?:const|let|var)\s+" + _NAME + r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::\s*[^=]+)?=>", r"^\s+(?:(?:static|async|get|set|public|private|protected|readonly)\s+)*" + _NAME + r"\s*\([^;{]*\)\s*(?::\s*[^{;]+)?\{\s*$"],
    classes={
        _MODS + r"class\s+" + _NAME + r"(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[\w$.]+))?(?:<[^>]*>)?(?:\s+implements\s+(?P<ifaces>[\w$., ]+))?": "class",
        _MODS + r"interface\s+" + _NAME + r"(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>[\w$., ]+))?": "interface",
        _MODS + r"enum\s+" + _NAME: "enum",
        _MODS + r"type\s+" + _NAME + r"(?:<[^>]*>)?\s*=": "type_alias",
    },
    imports=[r"^\s*import\s+(?:[\w$*{}\s,]+\s+from\s+)?['\"](?P<name>[^'\"]+)['\"]", r"require\(\s*['\"](?P<name>[^'\"]+)['\"]\s*\)"],
    variables=[r"^(?:export\s+)?(?:const|let|var)\s+" + _NAME + r"\s*[:=]"],
    exported_line=r"^\s*export\b",
)
_C = LanguageSpec(
    functions=[r"^(?!\s*(?:return|else|typedef|if|for|while)\b)[A-Za-z_][\w\s*&:<>,~]*?[\s*&](?:\w+::)*" + _NAME + r"\s*\([^;]*\)\s*(?:const)?\s*\{?\s*$"],
    classes={r"^\s*(?:typedef\s+)?struct\s+" + _NAME + r"\s*(?::\s*(?:public|private|protected)?\s*(?P<bases>[\w:, ]+))?\s*\{?\s*$": "struct", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?" + _NAME: "enum", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+" + _NAME + r"(?:\s*(?:final)?\s*:\s*(?:public|private|protected)?\s*(?P<bases>[\w:]+))?": "class", r"^\s*typedef\s+[^;{]*?\b" + _NAME + r"\s*;": "type_alias"},
    imports=[r"^\s*#\s*include\s*[<\"](?P<name>[^>\"]+)[>\"]"],
)
_JAVA = LanguageSpec(
    functions=[r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized|native|default|override|virtual|async)\s+)*[\w<>\[\],.? ]+\s+" + _NAME + r"\s*\([^;]*\)\s*(?:throws\s+[\w, .]+)?\s*\{?\s*$"],
    classes={_MODS + r"(?:class|record)\s+" + _NAME + r"(?:<[^{]*?>)?(?:\s+extends\s+(?P<bases>[\w.<>]+))?(?:\s+implements\s+(?P<ifaces>[\w.<>, ]+))?": "class", _MODS + r"interface\s+" + _NAME + r"(?:<[^{]*?>)?(?:\s+extends\s+(?P<bases>[\w.<>, ]+))?": "interface", _MODS + r"enum\s+" + _NAME: "enum"},
    imports=[r"^\s*(?:import|using)\s+(?:static\s+)?(?P<name>[\w.]+(?:\.\*)?)\s*;"],
    exported_line=r"\bpublic\b",
)
_COLON_BASES = r"(?:\s*[:(]\s*(?P<bases>[\w.]+))?"
SPECS: dict[str, LanguageSpec] = {
    "javascript": _JS, "jsx": _JS, "typescript": _JS, "tsx": _JS, "vue": _JS, "svelte": _JS, "c": _C, "cpp": _C, "java": _JAVA, "csharp": _JAVA,
    "python": LanguageSpec([r"^\s*(?:async\s+)?def\s+" + _NAME + r"\s*\("], {r"^\s*class\s+" + _NAME + r"\s*(?:\((?P<bases>[^)]*)\))?\s*:": "class"}, [r"^\s*import\s+(?P<name>[\w.]+)", r"^\s*from\s+(?P<name>[\w.]+)\s+import"], [r"^" + _NAME + r"\s*(?::[^=]+)?=(?!=)"], "#", "indent"),
    "go": LanguageSpec([r"^func\s+(?:\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*)?" + _NAME + r"\s*[\[(]"], {r"^type\s+" + _NAME + r"(?:\[[^\]]*\])?\s+struct\b": "struct", r"^type\s+" + _NAME + r"(?:\[[^\]]*\])?\s+interface\b": "interface", r"^type\s+" + _NAME + r"\s+=?\s*[\w\[\]*.]+\s*$": "type_alias"}, [r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<name>[\w./-]+)\"\s*$"], [r"^(?:var|const)\s+" + _NAME], receiver="owner", exported=r"^[A-Z]"),
    "rust": LanguageSpec([_MODS + r"fn\s+" + _NAME], {_MODS + r"struct\s+" + _NAME: "struct", _MODS + r"enum\s+" + _NAME: "enum", _MODS + r"trait\s+" + _NAME + r"(?:\s*:\s*(?P<bases>\w+))?": "interface", r"^\s*impl(?:<[^>]*>)?\s+(?:(?P<ifaces>[\w:]+)(?:<[^>]*>)?\s+for\s+)?" + _NAME: "class", _MODS + r"type\s+" + _NAME: "type_alias"}, [r"^\s*(?:pub\s+)?use\s+(?P<name>[\w:]+)"], [_MODS + r"static\s+(?:mut\s+)?" + _NAME], exported_line=r"^\s*pub\b"),
    "ruby": LanguageSpec([r"^\s*def\s+(?:self\.)?(?P<name>[\w?!]+)"], {r"^\s*class\s+(?P<name>[\w:]+)(?:\s*<\s*(?P<bases>[\w:]+))?": "class", r"^\s*module\s+(?P<name>[\w:]+)": "class"}, [r"^\s*require(?:_relative)?\s*\(?['\"](?P<name>[^'\"]+)['\"]"], [r"^(?P<name>[A-Z]\w*)\s*="], "#", "end"),
    "swift": LanguageSpec([_MODS + r"func\s+" + _NAME, _MODS + r"(?P<name>init|deinit)\b\s*[({?]"], {_MODS + r"(?:class|actor)\s+" + _NAME + _COLON_BASES: "class", _MODS + r"struct\s+" + _NAME + _COLON_BASES: "struct", _MODS + r"protocol\s+" + _NAME + _COLON_BASES: "interface", _MODS + r"enum\s+" + _NAME: "enum"}, [r"^\s*import\s+(?P<name>[\w.]+)"], [r"^(?:let|var)\s+" + _NAME], exported_line=r"\b(?:public|open)\b"),
    "kotlin": LanguageSpec([_MODS + r"fun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?" + _NAME], {_MODS + r"interface\s+" + _NAME: "interface", _MODS + r"enum\s+class\s+" + _NAME: "enum", _MODS + r"(?:class|object)\s+" + _NAME + r"(?:\([^)]*\))?(?:\s*:\s*(?P<bases>\w+))?": "class", _MODS + r"typealias\s+" + _NAME: "type_alias"}, [r"^\s*import\s+(?P<name>[\w.*]+)"], [r"^(?:val|var)\s+" + _NAME]),
    "dart": LanguageSpec([r"^\s*(?:static\s+)?[\w<>?,\[\] ]+\s+" + _NAME + r"\s*\([^;]*\)\s*(?:async\s*)?(?:\{|=>)"], {_MODS + r"class\s+" + _NAME + r"(?:<[^>]*>)?(?:\s+extends\s+(?P<bases>\w+))?(?:.*?\s+implements\s+(?P<ifaces>[\w, ]+))?": "class", r"^\s*enum\s+" + _NAME: "enum", r"^\s*typedef\s+" + _NAME: "type_alias"}, [r"^\s*import\s+['\"](?P<name>[^'\"]+)['\"]"]),
    "scala": LanguageSpec([_MODS + r"def\s+" + _NAME], {_MODS + r"(?:class|object)\s+" + _NAME + r"(?:\([^)]*\))?(?:\s+extends\s+(?P<bases>\w+))?": "class", _MODS + r"trait\s+" + _NAME + r"(?:\s+extends\s+(?P<bases>\w+))?": "interface", r"^\s*enum\s+" + _NAME: "enum"}, [r"^\s*import\s+(?P<name>[\w.]+)"], [r"^\s*(?:val|var)\s+" + _NAME]),
    "lua": LanguageSpec([r"^\s*(?:local\s+)?function\s+(?:(?P<owner>\w+)[.:])?" + _NAME, r"^\s*local\s+" + _NAME + r"\s*=\s*function"], {}, [r"require\s*\(?\s*['\"](?P<name>[^'\"]+)['\"]"], [r"^(?:local\s+)?" + _NAME + r"\s*=(?!=|\s*function)"], "--", "end", "owner"),
    "php": LanguageSpec([_MODS + r"function\s+&?" + _NAME], {_MODS + r"class\s+" + _NAME + r"(?:\s+extends\s+(?P<bases>[\w\\]+))?(?:\s+implements\s+(?P<ifaces>[\w\\, ]+))?": "class", _MODS + r"interface\s+" + _NAME + r"(?:\s+extends\s+(?P<bases>[\w\\, ]+))?": "interface", r"^\s*trait\s+" + _NAME: "struct"}, [r"^\s*use\s+(?P<name>[\w\\]+)"]),
}
SPECS["luau"] = SPECS["lua"]
_CALL = re.compile(r"(?<![\w$.])(?P<name>(?:[A-Za-z_$][\w$]*(?:\.|::|->|:))*[A-Za-z_$][\w$]*[?!]?)\s*\(")
_RUBY_CALL = re.compile(r"(?<![\w$.])(?P<name>(?:[A-Za-z_]\w*\.)*[a-z_]\w*[?!]?)(?=\(|\s+['\":\w])")


def register(language: str, spec: LanguageSpec) -> None:
    """Adds or replaces the rules of a language, on the driver; extract() ships them."""
    SPECS[language] = spec


class Sink:
    """Rows of one file."""

    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.rows = path, language, []
        self.ids: set[str] = set()
        self.file = self.node("file", path.rsplit("/", 1)[-1], path, 1, max(1, text.count("\n") + (not text.endswith("\n"))), qualified=path, ident=node_id("file", path), exported=False)

    def node(self, kind, name, own, start, end, parent=None, qualified=None, ident=None, **rest) -> str:
        ident = ident or node_id(kind, self.path, own)
        if ident in self.ids and kind in ("import", "variable", "constant"):
            return ident
        self.ids.add(ident)
        self.rows.append(_EMPTY | {"rec": "node", "id": ident, "kind": kind, "name": name, "qualified_name": qualified or f"{self.path}::{own}", "file_path": self.path, "language": self.language, "start_line": start, "end_line": end, "docstring": rest.get("doc"), "signature": rest.get("signature"), "is_exported": rest.get("exported", not name.startswith("_")), "is_async": rest.get("is_async", False), "is_static": rest.get("is_static", False)})
        if parent:
            self.edge(parent, ident, "contains", None)
        return ident

    def edge(self, source, target, kind, line, metadata=None):
        self.rows.append(_EMPTY | {"rec": "edge", "kind": kind, "file_path": self.path, "language": self.language, "source": source, "target": target, "line": line, "metadata": metadata})

    def ref(self, source, name, kind, line, metadata=None):
        if name:
            self.rows.append(_EMPTY | {"rec": "ref", "kind": kind, "name": name, "file_path": self.path, "language": self.language, "source": source, "line": line, "metadata": metadata})


#: Nodes below which there is nothing to find.
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue, ast.alias))
#: Characters of a Python file above which its rows are not kept together.
LARGE = 1 << 17


def python_rows(path: str, text: str) -> Iterator[dict]:
    """Rows of a Python file by its syntax tree; SyntaxError if it has none, and whatever the tree's walk raises, at once.

    A large file is walked twice, to know before its first row that none fails."""
    tree = ast.parse(text)
    if len(text) <= LARGE:
        return iter(list(_walked(path, text, tree)))
    for _ in _walked(path, text, tree):
        pass
    return _walked(path, text, tree)


def _walked(path: str, text: str, tree: ast.Module) -> Iterator[dict]:
    """Rows of one statement at the file's top after the other."""
    sink = Sink(path, "python", text)
    static = lambda n: any(isinstance(d, ast.Name) and d.id == "staticmethod" for d in n.decorator_list)

    def dotted(x) -> str:
        return ast.unparse(x) if isinstance(x, (ast.Name, ast.Attribute, ast.Call)) else ""

    def visit(node, owner: str, klass: str, top: bool):
        for x in ast.iter_child_nodes(node):
            if type(x) in _LEAVES:
                continue
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind, own = ("method", f"{klass}.{x.name}") if klass else ("function", x.name)
                ident = sink.node(kind, x.name, own, x.lineno, x.end_lineno, owner, doc=ast.get_docstring(x), signature=f"({ast.unparse(x.args)})", is_async=isinstance(x, ast.AsyncFunctionDef), is_static=static(x))
                for d in x.decorator_list:
                    sink.ref(ident, dotted(d.func if isinstance(d, ast.Call) else d), "decorates", d.lineno)
                visit(x, ident, "", False)
            elif isinstance(x, ast.ClassDef):
                ident = sink.node("class", x.name, x.name, x.lineno, x.end_lineno, owner, doc=ast.get_docstring(x))
                for b in x.bases:
                    sink.ref(ident, dotted(b.value if isinstance(b, ast.Subscript) else b), "extends", x.lineno)
                for d in x.decorator_list:
                    sink.ref(ident, dotted(d.func if isinstance(d, ast.Call) else d), "decorates", d.lineno)
                visit(x, ident, x.name, False)
            elif isinstance(x, (ast.Import, ast.ImportFrom)):
                module = "." * getattr(x, "level", 0) + (x.module or "") if isinstance(x, ast.ImportFrom) else None
                for a in x.names:
                    full = f"{module}.{a.name}".replace("..", ".") if module is not None else a.name
                    ident = sink.node("import", a.asname or a.name, full, x.lineno, x.end_lineno, owner, qualified=full, exported=False)
                    sink.ref(ident, module if module else a.name, "imports", x.lineno)
            else:
                if top and isinstance(x, (ast.Assign, ast.AnnAssign)):
                    for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                        for n in t.elts if isinstance(t, ast.Tuple) else [t]:
                            if isinstance(n, ast.Name) and not (n.id.startswith("__") and n.id.endswith("__")):
                                sink.node("constant" if n.id.isupper() and "_" in n.id else "variable", n.id, n.id, x.lineno, x.end_lineno, owner)
                if isinstance(x, ast.Call):
                    sink.ref(owner, ast.unparse(x.func) if isinstance(x.func, (ast.Name, ast.Attribute)) else "", "call", x.lineno)
                visit(x, owner, klass, top and isinstance(x, (ast.If, ast.Try, ast.With)))

    for x in tree.body:
        visit(ast.Module([x], []), sink.file, "", True)
        yield from sink.rows
        sink.rows.clear()
    yield from sink.rows  # of an empty file


def _block_end(lines: list[str], i: int, style: str) -> int:
    """Index of a block's last line."""
    indent = len(lines[i]) - len(lines[i].lstrip())
    if style != "braces":
        last = i
        for j in range(i + 1, len(lines)):
            if not lines[j].strip():
                continue
            now = len(lines[j]) - len(lines[j].lstrip())
            if now <= indent:
                return j if style == "end" and lines[j].strip().startswith("end") else last
            last = j
        return last
    depth, open_ = 0, False
    for j in range(i, len(lines)):
        for c in re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[j]):
            depth += (c == "{") - (c == "}")
            open_ |= c == "{"
        if open_ and depth <= 0:
            return j
        if not open_ and (lines[j].rstrip().endswith(";") or j > i + 5):
            return j
    return len(lines) - 1


def _docstring(lines: list[str], i: int) -> str | None:
    """What the lines after a header of one line say about it."""
    m = re.match(r"\s*[rR]?(\"{3}|'{3})(.*?)(?:\1|\Z)", "\n".join(lines[i + 1 : i + 200]), re.S)
    return "\n".join(x.strip() for x in m[2].strip().split("\n")) if m else None


def by_lines(path: str, language: str, text: str, spec: LanguageSpec) -> list[dict]:
    """Rows of a file by its language's line rules."""
    sink, lines = Sink(path, language, text), text.split("\n")
    classes = [(re.compile(p), k) for p, k in spec.classes.items()]
    functions, imports, variables = ([re.compile(p) for p in ps] for ps in (spec.functions, spec.imports, spec.variables))
    call = _RUBY_CALL if language == "ruby" else _CALL
    scopes: list[tuple[int, str, str]] = []  # (last line, id, class name or empty)
    block, decorators = False, []
    for i, line in enumerate(lines):
        bare = line.strip()
        if language == "python" and (m := re.match(r"@([\w.]+)", bare)):
            decorators.append((m[1], i + 1))
            continue
        if block or bare.startswith("/*"):
            block = "*/" not in bare
            continue
        if not bare or bare.startswith((spec.comment, "*")):
            continue
        while scopes and scopes[-1][0] < i:
            scopes.pop()
        owner, klass = (scopes[-1][1], scopes[-1][2]) if scopes else (sink.file, "")
        exported = lambda name, line=line: bool(re.search(spec.exported_line, line)) if spec.exported_line else bool(re.match(spec.exported, name))
        got = next(((m, k) for p, k in classes if (m := p.search(line))), None)
        declared = None
        if got:
            m, kind = got
            end = _block_end(lines, i, spec.blocks) if kind != "type_alias" else i
            ident = sink.node(kind, m["name"], m["name"], i + 1, end + 1, owner, exported=exported(m["name"]), doc=_docstring(lines, i) if language == "python" else None)
            for name, at in decorators:
                sink.ref(ident, name, "decorates", at)
            decorators = []
            groups = m.groupdict()
            for key, rel in (("bases", "extends"), ("ifaces", "implements")):
                for b in (groups.get(key) or "").split(","):
                    sink.ref(ident, re.sub(r"<.*", "", b).strip(), rel, i + 1)
            if kind != "type_alias":
                scopes.append((end, ident, m["name"]))
            continue
        for m in (m for p in imports if (m := p.search(line))):
            module = m["name"]
            short = re.split(r"[./:\\]+", module.rstrip("*./"))[-1] or module
            ident = sink.node("import", short, module, i + 1, i + 1, owner, qualified=module, exported=False)
            sink.ref(ident, module, "imports", i + 1)
            declared = m
            break
        if declared:
            continue
        m = next((m for p in functions if (m := p.search(line)) and m["name"] not in spec.keywords), None)
        if m:
            home = m.groupdict().get(spec.receiver) if spec.receiver else None
            home = home or klass
            end = _block_end(lines, i, spec.blocks)
            kind, own = ("method", f"{home}.{m['name']}") if home else ("function", m["name"])
            ident = sink.node(kind, m["name"], own, i + 1, end + 1, owner, exported=exported(m["name"]), signature=bare[:200], is_async="async " in line, is_static="static " in line or any(n == "staticmethod" for n, _ in decorators), doc=_docstring(lines, i) if language == "python" else None)
            for name, at in decorators:
                sink.ref(ident, name, "decorates", at)
            decorators = []
            scopes.append((end, ident, ""))
            owner, declared = ident, m
        elif not scopes:
            for m2 in (m2 for p in variables if (m2 := p.search(line)) and m2["name"] not in spec.keywords):
                name = m2["name"]
                sink.node("constant" if name.isupper() and "_" in name else "variable", name, name, i + 1, i + 1, owner, exported=exported(name))
                break
        for c in call.finditer(line, declared.end() if declared else 0):
            if c["name"] not in spec.keywords:
                sink.ref(owner, c["name"].replace("::", ".").replace("->", "."), "call", i + 1)
    return sink.rows


# ---- routes ----

_QUOTED = r"\(\s*r?['\"](?P<url>[^'\"]*)['\"]"
_DJANGO = re.compile(r"\b(?:re_path|path|url)\s*" + _QUOTED + r"\s*,\s*(?P<handler>[\w.]+(?:\([^)]*\))?)")
_DECORATOR = re.compile(r"^\s*@(?P<app>\w+)\.(?P<verb>route|api_route|get|post|put|delete|patch|head|options|trace)\s*" + _QUOTED + r"(?P<rest>[^\n]*)", re.M)
_HANDLER = re.compile(r"\s*(?:async\s+)?(?:def|class)\s+(\w+)")


def _line_numbers(text: str) -> Callable[[int], int]:
    """The line of an offset, for offsets that don't decrease much: it counts on from the last."""
    last = [0, 1]

    def line(offset: int) -> int:
        if offset < last[0]:
            last[:] = 0, 1
        last[1] += text.count("\n", last[0], offset)
        last[0] = offset
        return last[1]

    return line


def routes(path: str, text: str) -> list[tuple[str, str, str, str, int]]:
    """(framework, url, methods, handler, line) of the routes of a Python file; of one (url, handler) the first framework's.

    Which framework a verb's decorator belongs to shows in the imports; without any it counts as the first of the two.
    """
    if "path" not in text and "url" not in text and "@" not in text:
        return []
    found, at_line = [], _line_numbers(text)
    if re.search(r"(^|/|_)urls\.py$", path):
        for m in _DJANGO.finditer(text):
            handler = re.sub(r"\.as_view\(.*|\(.*", "", m["handler"])
            if handler != "include":
                found.append(("django", m["url"], "", handler.rsplit(".", 1)[-1], at_line(m.start())))
    lines = text.split("\n")
    fast = "fastapi" in text.lower() and "flask" not in text.lower()
    for m in _DECORATOR.finditer(text):
        at = at_line(m.start("app"))
        handler = None
        for line in lines[at : at + 10]:
            if not line.strip() or line.lstrip().startswith("@"):
                continue
            got = _HANDLER.match(line)
            handler = got[1] if got else None
            break
        listed = re.search(r"methods\s*=\s*[\[(](.*?)[\])]", m["rest"])
        if m["verb"] in ("route", "api_route"):
            methods = [x.strip().strip("'\"").upper() for x in listed[1].split(",") if x.strip()] if listed else ["GET"]
        else:
            methods = [m["verb"].upper()]
        framework = "fastapi" if m["verb"] in ("api_route", "trace") or (fast and m["verb"] != "route") else "flask"
        if handler:
            found.append((framework, m["url"], ",".join(methods), handler, at))
    order = {"django": 0, "flask": 1, "fastapi": 2}
    best: dict[tuple[str, str], tuple] = {}
    for r in sorted(found, key=lambda r: (order[r[0]], r[4])):
        best.setdefault((r[1], r[3]), r)
    return sorted(best.values(), key=lambda r: r[4])


def parse(path: str, language: str, text: str, specs: dict[str, LanguageSpec] | None = None) -> list[dict]:
    """All rows of one file. A language without rules gives the file's node alone."""
    return list(rows_of(path, language, text, specs))


def rows_of(path: str, language: str, text: str, specs: dict[str, LanguageSpec] | None = None) -> Iterator[dict]:
    """parse() row by row; of Python's, those of a statement at the file's top are made when they are asked for."""
    specs = SPECS if specs is None else specs
    if language != "python":
        yield from by_lines(path, language, text, specs[language]) if language in specs else Sink(path, language, text).rows
        return
    try:
        rows = python_rows(path, text)
    except (SyntaxError, ValueError, RecursionError):
        rows = iter(by_lines(path, language, text, specs["python"]))
    first = next(rows)
    yield first
    yield from rows
    sink = Sink(path, language, text)
    sink.rows.clear()
    for framework, url, methods, handler, line in routes(path, text):
        key = re.sub(r"[ /:]", "_", f"{framework}_{methods}_{url}")
        ident = sink.node("route", url, key, line, line, first["id"], exported=False, signature=methods)
        sink.ref(ident, handler, "function_ref", line, framework)
    yield from sink.rows


#: Rows that go to the JVM at once, so that a worker holds no more than one file's rows beside them.
CHUNK = 4096
_TYPES = [(c, {"int": pa.int32(), "boolean": pa.bool_()}.get(x.split()[1], pa.string())) for c, x in zip(COLUMNS, ROW.split(", "))]
_SCHEMA = pa.schema(_TYPES)


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in _TYPES], schema=_SCHEMA)


def extract(sources: DataFrame) -> DataFrame:
    """Tagged rows of a table (path, language, text). Files without text give none; several rows of one path give theirs each.

    Files are spread over all cores first: a table of few bytes, which is one task as it is read, may hold many files."""
    specs = dict(SPECS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for i in range(batch.num_rows):
                path, language, text = (c[i].as_py() for c in batch.columns)
                if text is not None:
                    for row in rows_of(path, language, text, specs):
                        rows.append(row)
                        if len(rows) >= CHUNK:
                            yield _table(rows)
                            rows = []
        if rows:
            yield _table(rows)

    spread_out = sources.select("path", "language", "text").repartition(spread(sources.sparkSession))
    return spread_out.mapInArrow(run, ROW)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, refs) of the tagged rows; rows should be stored, as all three read it."""
    nodes = rows.where("rec = 'node'").select("id", "kind", "name", "qualified_name", "file_path", "language", "start_line", "end_line", "docstring", "signature", "is_exported", "is_async", "is_static")
    edges = rows.where("rec = 'edge'").select("source", "target", "kind", "line", "metadata")
    refs = rows.where("rec = 'ref'").select(F.col("source").alias("from_node_id"), F.col("name").alias("reference_name"), F.col("kind").alias("reference_kind"), "line", "file_path", "language", "metadata")
    return nodes, edges, refs


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, link) of every link in the pages' markup, each occurrence."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
