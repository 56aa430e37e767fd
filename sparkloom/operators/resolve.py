"""Reference resolution: candidates of all strategies in one plan, of which each reference takes the best.

Strategies in order: an import of the file, a definition in the same file, a module of that name, the name anywhere, and
the reference's own list of candidates. Whatever does not depend on the reference is reduced first, one row for each
(file, name) or name, so that a name of many definitions doesn't multiply the references of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.functions import text as fn

#: Kinds of references that aren't kinds of edges as they are.
EDGE_OF = {"call": "calls", "calls": "calls", "function_ref": "references"} | {k: k for k in ("imports", "exports", "extends", "implements", "type_of", "returns", "instantiates", "overrides", "decorates")}
NOT_DEFINED = ("file", "import", "module")


def edge_kind(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EDGE_OF.items() for x in pair))
    return F.coalesce(F.element_at(table, kind), F.lit("references"))


def import_map(nodes: DataFrame) -> DataFrame:
    """(file_path, name, module, qualified_name, import_id) of every import node."""
    return nodes.where("kind = 'import'").select("file_path", "name", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("module"), "qualified_name", F.col("id").alias("import_id"))


def modules(files: DataFrame) -> DataFrame:
    """(module, path): every file's module; the packages above it with path null."""
    own = files.select(fn.module_of(F.col("path")).alias("module"), "path").where("module <> ''")
    above = own.select(F.explode(F.expr("transform(sequence(1, greatest(size(split(module, '[.]')) - 1, 1)), i -> if(size(split(module, '[.]')) > 1, array_join(slice(split(module, '[.]'), 1, i), '.'), null))")).alias("module")).where("module IS NOT NULL").distinct()
    return own.unionByName(above.join(own.select("module"), "module", "left_anti").select("module", F.lit(None).cast("string").alias("path")))


def _first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def _found(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, found) of references with any candidate: an array of (priority, target), at most one of each strategy.

    References are joined twice, by (file, name) and by name, with what each key leads to, one row a key."""
    sym = nodes.where(~F.col("kind").isin(*NOT_DEFINED))
    order = [F.col("start_line"), F.col("id")]
    by_file = _first(sym, ["file_path", "name"], order).select("file_path", "name", "id")
    file_node = nodes.where("kind = 'file'").select(F.col("file_path").alias("_path"), F.col("id").alias("_file"))
    mods = modules(files).where("path IS NOT NULL").groupBy("module").agg(F.min("path").alias("_path"))

    # 1: what the file's imports of that name lead to, once for each (file, name)
    there = import_map(nodes).join(mods, "module", "left")
    in_module = there.join(by_file.select(F.col("file_path").alias("_path"), "name", F.col("id").alias("_a")), ["_path", "name"], "left")
    named = sym.groupBy("qualified_name").agg(F.min("id").alias("_b"))
    reached = in_module.join(named, "qualified_name", "left").join(file_node, "_path", "left")
    best = reached.select("file_path", "name", "import_id", F.coalesce("_a", "_b", "_file").alias("_one"), F.when(F.col("_a").isNotNull(), 1.1).when(F.col("_b").isNotNull(), 1.2).otherwise(1.3).alias("_p")).where("_one IS NOT NULL")
    best = _first(best, ["file_path", "name"], [F.col("_p"), F.col("import_id")]).drop("import_id")
    # 2: a definition in the same file
    per_file = best.join(by_file.withColumnRenamed("id", "_two"), ["file_path", "name"], "full_outer")
    # 3: a module with files; without a file node nothing else is tried
    at_module = mods.join(file_node, "_path", "left").select(F.col("module").alias("name"), "_file", F.lit(True).alias("_module"))
    # 4: the name anywhere: exported or public first. The same file has been tried in 2.
    hidden = ~(F.coalesce("is_exported", F.lit(False)) | ~fn.is_private(F.col("name")))
    anywhere = _first(sym, ["name"], [hidden, F.col("file_path"), *order]).select("name", F.col("id").alias("_four"))
    per_name = at_module.join(anywhere, "name", "full_outer")

    keyed = refs.select("ref_id", "file_path", F.col("reference_name").alias("name")).join(per_file, ["file_path", "name"], "left").join(per_name, "name", "left")
    one = lambda there, priority, target: F.when(there, F.struct(priority.cast("double").alias("priority"), target.alias("target")))
    ways = [one(F.col("_one").isNotNull(), F.col("_p"), F.col("_one")), one(F.col("_two").isNotNull(), F.lit(2.0), F.col("_two")), one(F.col("_module"), F.lit(3.0), F.col("_file")), one(F.col("_four").isNotNull(), F.lit(4.0), F.col("_four"))]
    if "candidates" in refs.columns:
        # 5: the reference's own candidates, by qualified name, in their order
        all_named = nodes.groupBy(F.col("qualified_name").alias("_q")).agg(F.min("id").alias("_five"))
        five = refs.select("ref_id", F.posexplode("candidates").alias("_i", "_q")).join(all_named, "_q").groupBy("ref_id").agg(F.min_by("_five", "_i").alias("_five"))
        keyed = keyed.join(five, "ref_id", "left")
        ways.append(one(F.col("_five").isNotNull(), F.lit(5.0), F.col("_five")))
    return keyed.select("ref_id", F.filter(F.array(*ways), lambda w: w.isNotNull()).alias("found")).where("size(found) > 0")


def candidates(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, target, priority): at most one candidate of each strategy; refs has ref_id. target null with priority 3 ends the search."""
    return _found(refs, nodes, files).select("ref_id", F.explode("found").alias("f")).select("ref_id", "f.target", "f.priority")


def resolve(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_id, target, priority) of every reference that is resolved. A reference to itself's node by import is left out."""
    best = _found(refs, nodes, files).select("ref_id", F.array_min("found").alias("b"))
    return best.where("b.target IS NOT NULL").select("ref_id", F.col("b.target").alias("target"), F.col("b.priority").alias("priority"))


def resolved_edges(refs: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges of the resolved references; refs stay as they are, so resolving again after a change gives a whole result."""
    got = resolve(refs, nodes, files)
    return refs.join(got, "ref_id").where("from_node_id <> target").select(F.col("from_node_id").alias("source"), "target", edge_kind(F.col("reference_kind")).alias("kind"), "line", F.lit("resolved").alias("provenance"))
