"""Exact deduplication by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. A global sort gives each distinct block its rank as an
integer name; adjacent names are paired and named again, until one name is left of each document. Texts of equal
length take the same number of rounds, so (length, last name) is an identity free of collisions: contents are
compared, never digests. As every round keeps the order, the identity is also the rank of the text by (length, bytes).
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sparkloom.llm.common import drop_stored, small, stored, tidied

BLOCK_BYTES = 1024
#: Rows that are sampled, for each partition to come, to find the borders of the ranges. They go to the driver with whole
#: blocks; Spark's usual hundred would take gigabytes there for a large corpus. Uneven ranges cost time, never results.
SAMPLED = 20


def named(df: DataFrame, by: list[str], keep: list[str], tag: str) -> DataFrame:
    """keep columns and `name`, the dense rank of the by columns over all rows, from 0.

    Rows are range-partitioned by (by, keep), so that a value of many copies is spread over tasks; a rank that goes on
    from the partition before is found by comparing the neighbours' edge values. by columns must not be null.
    """
    order = [*by, *keep]
    ranged = df.select(*order).repartitionByRange(*order).sortWithinPartitions(*by)
    kinds = {f.name: f.dataType for f in df.schema}
    out = T.StructType([*(T.StructField(k, kinds[k]) for k in keep), T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType()), *(T.StructField(f"_{e}_{b}", kinds[b]) for e in ("first", "last") for b in by)])

    def rank(batches):
        part, rank, last, first = TaskContext.get().partitionId(), -1, None, None
        schema = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(batch.schema.get_field_index(b)) for b in by]
            head, tail = [c[0] for c in cols], [c[n - 1] for c in cols]
            new = None
            for c in cols:
                x = pc.not_equal(c.slice(1), c.slice(0, n - 1))
                new = x if new is None else pc.or_(new, x)
            start = rank + (last is None or head != last)
            ranks = pa.concat_arrays([pa.array([start], pa.int64()), pc.add(pc.cumulative_sum(new.cast(pa.int64())), start).cast(pa.int64())]) if n > 1 else pa.array([start], pa.int64())
            rank, last, first = ranks[n - 1].as_py(), tail, first or head
            data = {k: batch.column(batch.schema.get_field_index(k)) for k in keep}
            data |= {"_part": pa.array([part] * n, pa.int32()), "_rank": ranks}
            data |= {f"_{e}_{b}": pa.nulls(n, c.type) for e in ("first", "last") for b, c in zip(by, cols)}
            got = pa.RecordBatch.from_pydict(data)
            schema = got.schema
            yield got
        if schema is not None:  # the partition's edges, in a row without a rank of a record: _part is negative
            row = {k: pa.nulls(1, schema.field(k).type) for k in keep} | {"_part": pa.array([-1 - part], pa.int32()), "_rank": pa.array([rank], pa.int64())}
            row |= {f"_first_{b}": pa.array([v.as_py()], v.type) for b, v in zip(by, first)} | {f"_last_{b}": pa.array([v.as_py()], v.type) for b, v in zip(by, last)}
            yield pa.RecordBatch.from_pydict({f.name: row[f.name] for f in schema})

    spark, key = df.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition"
    usual = spark.conf.get(key)
    spark.conf.set(key, SAMPLED)
    try:
        table = stored(ranged.mapInArrow(tidied(rank), out), tag)
    finally:
        spark.conf.set(key, usual)
    edges = table.where("_part < 0").select((-1 - F.col("_part")).alias("_part"), "_rank", *(f"_{e}_{b}" for e in ("first", "last") for b in by))
    # One row a partition: this window and the broadcast grow with the number of partitions only.
    by_part = W.orderBy("_part")
    same = F.lit(True)
    for b in by:
        same &= F.lag(f"_last_{b}").over(by_part) == F.col(f"_first_{b}")
    edges = edges.select("_part", "_rank", F.when(F.coalesce(same, F.lit(False)), 1).otherwise(0).alias("_goes_on"))
    until = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offset = edges.select("_part", (F.coalesce(F.sum(F.col("_rank") + 1).over(until), F.lit(0)) - F.sum("_goes_on").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, 0))).alias("_offset"))
    return table.where("_part >= 0").join(small(offset, 16), "_part").select(*keep, (F.col("_rank") + F.col("_offset")).alias("name"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(uid, doc_id, n_bytes, identity) of every row whose text isn't null.

    uid tells repeated rows apart: docs must be a table scan or another deterministic input.
    """
    src = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("text").cast("binary").alias("b")).where("b IS NOT NULL")
    n = F.octet_length("b").cast("long")
    blocks = src.select("uid", "doc_id", n.alias("n_bytes"), F.posexplode(F.expr(f"transform(sequence(0, cast(ceil(greatest(octet_length(b), 1) / {block_bytes}D) AS int) - 1), i -> substring(b, i * {block_bytes} + 1, {block_bytes}))")).alias("pos", "block"))
    keep = ["uid", "doc_id", "n_bytes", "pos"]
    level = stored(named(blocks, ["block"], keep, "blocks").withColumn("width", F.greatest(F.ceil(F.col("n_bytes") / float(block_bytes)), F.lit(1)).cast("long")), "names")
    done = level.where("width = 1").select("uid", "doc_id", "n_bytes", "name")
    most = level.agg(F.max("width")).first()[0] or 1
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        pairs = (
            level.where("width > 1")
            .groupBy("uid", "doc_id", "n_bytes", "width", (F.col("pos").cast("long") / 2).cast("long").cast("int").alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).cast("long").alias("b"))
            .select("uid", "doc_id", "n_bytes", F.ceil(F.col("width") / 2).cast("long").alias("width"), "pos", "a", "b")
        )
        level = stored(named(pairs, ["a", "b"], ["uid", "doc_id", "n_bytes", "pos", "width"], "pairs"), "names")
        done = done.unionByName(level.where("width = 1").select("uid", "doc_id", "n_bytes", "name"))
    return named(done, ["n_bytes", "name"], ["uid", "doc_id"], "identity").withColumnRenamed("name", "identity")


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: doc_id, identity, keep_id, n_copies, duplicate.

    keep_id is the least doc_id among the rows of equal text; duplicate is false for just one of them. Nulls: a null
    text has a null identity, is its own copy (n_copies 1) and no duplicate; a null doc_id comes last in its group.
    Empty texts are equal to each other. Other columns of docs are ignored. An empty table gives no rows.
    """
    rows = identities(docs, block_bytes)
    # partial aggregates first: the copies of one text, however many, are never in one task
    groups = rows.groupBy(F.col("identity").alias("_i")).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("_first"))
    groups = stored(groups.select("_i", "keep_id", "n_copies", F.col("_first.uid").alias("_first")), "groups")
    found = rows.join(small(groups, 40), F.col("identity") == F.col("_i")).select("doc_id", "identity", "keep_id", "n_copies", (F.col("uid") != F.col("_first")).alias("duplicate"))
    none = docs.where("text IS NULL").select("doc_id", F.lit(None).cast("long").alias("identity"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(False).alias("duplicate"))
    return found.unionByName(none)


ORACLE = """
SELECT doc_id, CASE WHEN text IS NOT NULL THEN dense_rank() OVER (PARTITION BY text IS NULL ORDER BY strlen(text), text) - 1 END AS identity,
  CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keep_id,
  CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS n_copies,
  text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 AS duplicate
FROM documents
"""

__all__ = ["BLOCK_BYTES", "ORACLE", "drop_stored", "exact_duplicates", "identities", "named"]
