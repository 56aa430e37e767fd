"""Scalar functions over names, paths and queries, as Column expressions; and the query language's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower-cased suffix to language.
EXTENSIONS = {
    f".{ext}": language
    for language, exts in {
        "typescript": "ts mts cts", "tsx": "tsx", "javascript": "js mjs cjs", "jsx": "jsx", "arkts": "ets", "python": "py pyi", "go": "go", "rust": "rs",
        "java": "java", "kotlin": "kt kts", "c": "c h", "cpp": "cpp cc cxx hpp hxx", "csharp": "cs", "php": "php", "ruby": "rb rake", "swift": "swift",
        "dart": "dart", "svelte": "svelte", "vue": "vue", "astro": "astro", "liquid": "liquid", "pascal": "pas pp", "scala": "scala", "lua": "lua",
        "luau": "luau", "objc": "m mm", "r": "r", "solidity": "sol", "nix": "nix", "terraform": "tf tfvars", "yaml": "yaml yml", "twig": "twig",
        "xml": "xml", "properties": "properties", "cfml": "cfm", "cfscript": "cfc", "cfquery": "cfquery", "cobol": "cbl cob", "vbnet": "vb",
        "erlang": "erl", "razor": "cshtml razor",
    }.items()
    for ext in exts.split()
}

STOP_WORDS = frozenset(
    """a above add after again all also an and any are as at be been before being below between but by can class const could create data delete
    did do does during each every few for from function further get had has have here id in interface into is it item its just let list make many
    may method might most must name need new no nor not now obj of on once only or other remove return same set shall should so some such than that
    the then there these this those through to too type under update value var very was were will with would""".split()
)

_LOOK_UP = "get load retrieve read fetch request"
_CALLED_BACK = "callback handler listener on"
ALIASES = {
    word: other.split()
    for word, other in {
        "bool": "boolean bool", "config": "configuration settings options config", "create": "add insert new create make build",
        "delete": "remove drop delete clear erase", "elem": "element elem", "err": "error err exception", "fetch": _LOOK_UP, "fetching": _LOOK_UP,
        "find": "search query lookup find locate get", "fn": "function func fn", "handler": _CALLED_BACK,
        "init": "initialize setup init bootstrap start", "listener": _CALLED_BACK, "msg": "message msg", "num": "number num count",
        "req": "request req", "resp": "response resp", "save": "store persist save write commit", "str": "string str",
        "update": "edit modify change update set", "utils": "utilities helpers tools utils",
    }.items()
}

#: Python's special methods: a reference to one counts only within its own file.
SPECIAL_METHODS = tuple(
    f"__{x}__"
    for x in "add and call contains del delattr delitem enter eq exit floordiv format ge getattr getitem gt hash init iter le len lt mod mul ne new next or pow repr setattr setitem str sub truediv xor".split()
)


def language_of(path: Column) -> Column:
    """Language by the lower-cased suffix, null for none that is known."""
    table = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    return F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """What stands before the last slash, or a dot."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def normal_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def module_of(path: Column) -> Column:
    """Dotted module of a file: without its suffix, and a package's initial file names the package."""
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/", ".")
    return F.regexp_replace(dotted, r"(^|\.)__init__$", "")


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def segments(name: Column) -> Column:
    """Lower-cased parts of an identifier: cut at underscores, hyphens and changes of case, not at digits."""
    camel = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
    parts = F.flatten(F.transform(F.split(name, "[_-]+"), lambda x: F.split(x, camel)))
    return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(x))


def tokens(text: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def candidates(prose: Column) -> Column:
    """Words of a sentence worth looking up, in order, each followed by its aliases, none twice."""
    words = F.regexp_extract_all(F.lower(prose), F.lit("([a-z0-9]+)"), F.lit(1))
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*sorted(STOP_WORDS)))
    table = F.create_map(*(x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(F.array(w), F.coalesce(F.element_at(table, w), F.array().cast("array<string>"))))))


def glob_regex(pattern: str, path: bool = False) -> str:
    """Anchored regular expression of a shell pattern. path: * and ? stop at a slash, ** doesn't."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if path and pattern[i : i + 3] == "**/":
                out, i = out + "(?:.*/)?", i + 3
                continue
            if path and pattern[i : i + 2] == "**":
                out, i = out + ".*", i + 2
                continue
            out += "[^/]*" if path else ".*"
        elif c == "?":
            out += "[^/]" if path else "."
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def any_glob(col: Column, patterns: list[str], ignore_case: bool = False) -> Column:
    return reduce(lambda a, b: a | b, (col.rlike(("(?i)" if ignore_case else "") + "(?s)" + glob_regex(p)) for p in patterns), F.lit(False))


def is_private(name: Column) -> Column:
    return name.startswith("_")


@dataclass
class Query:
    """A parsed search: what to look for, and the fields it is narrowed to."""

    text: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)


def parse_query(query: str) -> Query:
    """Fields kind:, lang: and path: in any case; quoted parts are text, as is the rest."""
    got, rest = Query(), []
    where = {"kind": got.kinds, "lang": got.languages, "path": got.paths}
    for part in re.findall(r'(?:"[^"]*"|[^\s"]+)+', query):
        name, colon, value = part.partition(":")
        if part[0] == part[-1] == '"':
            rest.append(part[1:-1])
        elif colon and value and name.lower() in where:
            where[name.lower()].append(value.strip().lower())
        else:
            rest.append(part)
    got.text = " ".join(rest)
    return got
