"""Source trees as distributed file scans: listing, ignore rules, and contents with their hashes."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as fn

MOST_BYTES = 1 << 20
SKIPPED_DIRS = ("node_modules", "__pycache__", "venv", "vendor", "dist", "build", "target", "Pods", "out")


@dataclass
class ScanOptions:
    """What a scan takes: globs over the relative path; suffix to language beyond the known ones; the root's ignore file."""

    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    extensions: dict[str, str] = field(default_factory=dict)
    ignore_file: str = ""
    respect_ignore: bool = True

    @classmethod
    def from_json(cls, text: str) -> ScanOptions:
        """From a project's configuration; unknown keys are an error."""
        raw = json.loads(text)
        known = {"include": "include", "exclude": "exclude", "extensions": "extensions", "include_ignored": "include_ignored"}
        if bad := set(raw) - set(known):
            raise ValueError(f"unknown settings: {', '.join(sorted(bad))}")
        return cls(raw.get("include", []), raw.get("exclude", []), {k.lower(): v for k, v in raw.get("extensions", {}).items()}, respect_ignore=not raw.get("include_ignored", False))


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """(regular expression over the relative path, ignored) of each line of an ignore file, in order."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[1:] if keep else line
        folder, line = line.endswith("/"), line.rstrip("/")
        rooted = "/" in line
        body = fn.glob_regex(line.lstrip("/"), path=True)[1:-1]
        rules.append(("^" + ("" if rooted else "(?:.*/)?") + body + ("/.*" if folder else "(?:/.*)?") + "$", not keep))
    return rules


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Whether the last rule that fits a path ignores it."""
    return reduce(lambda got, r: F.when(path.rlike(r[0]), F.lit(r[1])).otherwise(got), rules, F.lit(False))


def wanted(path: Column, options: ScanOptions) -> Column:
    """No hidden or generated folder, no hidden, backup or conflict file, and the options' rules."""
    hidden = path.rlike(r"(^|/)\.") | path.rlike("(^|/)(" + "|".join(map(re.escape, SKIPPED_DIRS)) + ")/")
    name = fn.base_name(path)
    ok = ~hidden & ~name.contains("sync-conflict") & ~name.endswith(".bak")
    if options.include:
        ok &= fn.any_glob(path, options.include)
    if options.exclude:
        ok &= ~fn.any_glob(path, options.exclude)
    if options.respect_ignore and options.ignore_file:
        ok &= ~ignored(path, ignore_rules(options.ignore_file))
    return ok


def language(path: Column, options: ScanOptions) -> Column:
    known = fn.language_of(path)
    if not options.extensions:
        return known
    table = F.create_map(*(F.lit(x) for pair in options.extensions.items() for x in pair))
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))), known)


#: Files that are named to the source one by one; of more, the tree is listed and joined.
NAMED_FILES = 4096


def scan(spark: SparkSession, root: str, options: ScanOptions | None = None, content: bool = False, most_bytes: int | None = None, only: list[str] | None = None) -> DataFrame:
    """(path, language, size, modified_at[, content]) of the source files under root; without content nothing is read.

    most_bytes: files above it are left out before a byte of them is read. only: these relative paths, of which the missing
    are left out; the tree isn't listed.
    """
    options = options or ScanOptions()
    base = str(root).rstrip("/")
    reader = spark.read.format("binaryFile")
    if only is None:
        files = reader.option("recursiveFileLookup", True).load(base)
    else:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        there = []
        for p in only:
            path = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(base), jvm.org.apache.hadoop.fs.Path(None, None, p))
            if path.getFileSystem(conf).exists(path):
                there.append(re.sub(r"([\\*?\[\]{}])", r"\\\1", path.toString()))
        files = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    if most_bytes is not None:
        files = files.where(F.col("length") <= most_bytes)
    under = unquote(PurePosixPath(base.removeprefix("file://")).as_posix())
    path = F.regexp_replace(F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"^[a-z0-9]+:/+", "/"), "^" + re.escape(under) + "/", "")
    cols = [path.alias("path"), F.unix_millis("modificationTime").alias("modified_at"), F.col("length").alias("size"), *(["content"] if content else [])]
    found = files.select(*cols).where(wanted(F.col("path"), options))
    found = found.withColumn("language", language(F.col("path"), options)).where("language IS NOT NULL")
    return found.select("path", "language", "size", "modified_at", *(["content"] if content else []))


def read_sources(spark: SparkSession, root: str, options: ScanOptions | None = None, most_bytes: int = MOST_BYTES, only: list[str] | None = None) -> DataFrame:
    """scan() with text, content_hash and problem: file_too_large above most_bytes, of which no byte is read: the text is null
    and size and time stand for the contents."""
    files = scan(spark, root, options, True, most_bytes, only)
    fits = files.select("path", "language", "size", "modified_at", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("content_hash"), F.lit(None).cast("string").alias("problem"))
    large = scan(spark, root, options, only=only).where(F.col("size") > most_bytes)
    mark = F.sha2(F.concat_ws(":", F.col("size").cast("string"), F.col("modified_at").cast("string")).cast("binary"), 256)
    return fits.unionByName(large.select("path", "language", "size", "modified_at", F.lit(None).cast("string").alias("text"), mark.alias("content_hash"), F.lit("file_too_large").alias("problem")))


def name_tokens(manifests: DataFrame) -> DataFrame:
    """(token): lower-cased parts of the project's name, from (path, text) of its manifests and its folder's name (path '.')."""
    from_json = F.get_json_object("text", "$.name")
    from_toml = F.regexp_extract("text", r"""(?m)^name\s*=\s*["']?([^"'\n]+)""", 1)
    name = F.when(F.col("path").endswith(".json"), from_json).when(F.col("path") == ".", F.col("text")).otherwise(from_toml)
    return manifests.select(F.explode(fn.segments(F.regexp_replace(F.trim(name), r"[^\w-]+", "_"))).alias("token")).where("length(token) > 1").distinct()
