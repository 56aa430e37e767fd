"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule stands for the golden-ratio point frac(i * phi), in 31-bit integers so that every engine gets
the same. The interval of the cumulative weights in which it falls is its source. Each source's documents, shuffled by
a hash, form one stream of tokens, cut into blocks of equally many tokens. The r-th slot of a source takes its block
r modulo the number of its blocks; the quotient is the epoch. Sums and ranks over a source are formed in two steps
(per bucket, then over the buckets), so that a hot source is spread over many tasks.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sparkloom.llm.common import small, spread, stored

BLOCK_TOKENS = 2048
M, PHI = 1 << 31, 1327217885
#: Documents of a source in one bucket of its stream, and slots in one chunk of the schedule.
BUCKET_DOCS, CHUNK_SLOTS = 20_000, 1 << 20
#: Tokens of whole documents in one partition.
PART_TOKENS = 1 << 23


#: What parts white-space tokens.
SPACE = r" \n\r\t"


def n_tokens() -> Column:
    """The number of white-space tokens, that is runs of other characters; 0 for a null or empty text."""
    return F.coalesce(F.size(F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0))), F.lit(0)).cast("long")


def place() -> Column:
    """The place of a document in its source's shuffled stream: 32 bits of a hash of its doc_id (null: of '')."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")


def target_weights(totals: dict[str | None, int]) -> dict[str | None, int]:
    """Default weights: the square root of a source's tokens, which lifts small sources and lowers hot ones."""
    return {s: math.isqrt(n) for s, n in totals.items() if n}


def schedule(spark: SparkSession, weights: dict[str | None, int], slots: int) -> DataFrame:
    """slot, source, rank: rank counts a source's slots from 0. A source of weight 0 gets no slot."""
    names = sorted((s for s, w in weights.items() if w > 0), key=lambda s: (s is None, s))
    total = sum(weights[s] for s in names)
    if not names or not slots:
        return spark.createDataFrame([], "slot long, source string, rank long")
    cuts, upto = [0], 0
    for s in names:
        upto += weights[s]
        cuts.append(upto * M // total)
    used = [k for k in range(len(names)) if cuts[k + 1] > cuts[k]]
    names, cuts = [names[k] for k in used], [0, *(cuts[k + 1] for k in used)]
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") % M * PHI % M).cast("double").alias("u"))
    if len(names) > 1:
        points = Bucketizer(splits=[float(c) for c in cuts], inputCol="u", outputCol="k").transform(points)
    else:
        points = points.withColumn("k", F.lit(0.0))
    at = points.select("slot", F.col("k").cast("int").alias("k"), (F.col("slot") / CHUNK_SLOTS).cast("long").alias("chunk"))
    before = at.groupBy("k", "chunk").count().select("k", "chunk", F.coalesce(F.sum("count").over(W.partitionBy("k").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = at.withColumn("r", F.row_number().over(W.partitionBy("k", "chunk").orderBy("slot")) - 1).join(before, ["k", "chunk"])
    named = spark.createDataFrame(list(enumerate(names)), "k int, source string")  # one row a source
    return ranked.join(small(named, 64, len(names)), "k").select("slot", "source", (F.col("r") + F.col("before")).alias("rank"))


def streams(docs: DataFrame) -> tuple[DataFrame, dict[str | None, int], DataFrame]:
    """(rows with tokens: uid, doc_id, source, n_tokens and `begin`, the first token's place in the source's stream; tokens
    per source; uid of the rows without tokens). The texts are read once; uid is a row's place in docs.

    Order in a stream: place, doc_id, text length, then any. A second sum over buckets gives where a bucket begins.
    """
    ids = stored(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "source", n_tokens().alias("n_tokens"), place().alias("place")), "mixing")
    read = ids.where("n_tokens > 0")
    per_source = read.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()  # one row a source
    totals, most = {r.source: r.n for r in per_source}, max((r.docs for r in per_source), default=1)
    width = M * 2 // min(1 << 20, 1 << max(0, math.ceil(math.log2(max(1, most / BUCKET_DOCS)))))
    read = read.withColumn("bucket", (F.col("place") / width).cast("long"))
    sums = read.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    run = W.partitionBy("source", "bucket").orderBy("place", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    inside = read.withColumn("_in", F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    buckets = len(totals) * (M * 2 // width)
    rows = inside.join(small(before, 64, buckets), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    return rows.select("uid", "doc_id", "source", "n_tokens", (F.col("_in") + F.col("before")).alias("begin")), totals, ids.where("n_tokens = 0").select("uid")


def plan(spark: SparkSession, totals: dict[str | None, int], weights: dict[str | None, int] | None, block_tokens: int, slots: int | None) -> tuple[DataFrame, int]:
    """(slot, _source, block and epoch of every slot; number of slots)."""
    weights = target_weights(totals) if weights is None else {s: w for s, w in weights.items() if totals.get(s)}
    blocks = {s: -(-n // block_tokens) for s, n in totals.items()}
    slots = sum(blocks.values()) if slots is None else slots
    size = spark.createDataFrame([(s, b) for s, b in blocks.items()], "_s string, blocks long")
    at = schedule(spark, weights, slots).join(small(size, 64, len(blocks)), F.col("source").eqNullSafe(F.col("_s")))
    return at.select("slot", F.col("source").alias("_source"), (F.col("rank") % F.col("blocks")).alias("block"), (F.col("rank") / F.col("blocks")).cast("long").cast("int").alias("epoch")), slots


def mix_sources(docs: DataFrame, weights: dict[str | None, int] | None = None, block_tokens: int = BLOCK_TOKENS, slots: int | None = None) -> DataFrame:
    """The scheduled pieces of documents: slot, source, epoch, block, doc_id, first_token, n_tokens; slot gives the order.

    Blocks hold block_tokens tokens each, but for a source's last one; a document is cut where a block ends. By default
    there are as many slots as blocks: a source above its weight isn't used up, one below it begins a further epoch.
    docs must be a table scan or another input that gives its rows in the same order when read again.
    A null source is a source; null, empty and blank texts have no tokens and no piece; null doc_ids share one place and come
    first in it; repeated rows follow each other. An empty table gives no rows.
    """
    rows, totals, _ = streams(docs)
    at, _ = plan(docs.sparkSession, totals, weights, block_tokens, slots)
    end = F.col("begin") + F.col("n_tokens")
    cut = rows.select("doc_id", "source", "begin", end.alias("end"), F.explode(F.sequence((F.col("begin") / block_tokens).cast("long"), ((end - 1) / block_tokens).cast("long"))).alias("block"))
    return cut.join(at, F.col("source").eqNullSafe(F.col("_source")) & (cut.block == at.block)).select(
        "slot",
        "source",
        "epoch",
        cut.block.alias("block"),
        "doc_id",
        (F.greatest(F.col("begin"), cut.block * block_tokens) - F.col("begin")).alias("first_token"),
        (F.least(F.col("end"), (cut.block + 1) * block_tokens) - F.greatest(F.col("begin"), cut.block * block_tokens)).alias("n_tokens"),
    )


def mixed_documents(docs: DataFrame, weights: dict[str | None, int] | None = None, block_tokens: int = BLOCK_TOKENS, slots: int | None = None) -> DataFrame:
    """Whole documents in the order of the schedule, with the columns of docs, whatever their names.

    A document comes at every slot whose block holds its first token, so that a block is equal to the others within one
    document. Rows are partitioned by ranges of slots and sorted; of the texts only that one shuffle is made, after the
    plan over ids has been joined (by a broadcast if it is small, else by another shuffle). Documents without tokens come
    once, at the end. Cases as in mix_sources, for which docs must be an input that can be read again.
    """
    spark = docs.sparkSession
    rows, totals, bare = streams(docs)
    at, slots = plan(spark, totals, weights, block_tokens, slots)
    at = at.withColumnRenamed("block", "_block")
    rows = rows.withColumn("block", (F.col("begin") / block_tokens).cast("long"))
    order = rows.join(at, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))).select("uid", "slot", "begin")
    order = stored(order.unionByName(bare.select("uid", F.lit(slots).cast("long").alias("slot"), F.lit(0).cast("long").alias("begin"))), "order")
    count = order.count()
    parts = spread(spark, slots, max(1, PART_TOKENS // block_tokens))
    tail = spread(spark, bare.count(), 1 << 20)
    part = F.when(F.col("slot") < slots, (F.col("slot") * parts / max(slots, 1)).cast("int")).otherwise(parts + F.pmod(F.xxhash64("uid"), F.lit(tail)).cast("int"))
    whole = docs.select(F.monotonically_increasing_id().alias("_uid"), F.struct(*docs.columns).alias("_row"))
    out = whole.join(small(order, 40, count), F.col("_uid") == F.col("uid")).select("slot", "begin", "_uid", "_row", part.alias("_part"))
    out = out.repartitionById(parts + tail, F.col("_part"))
    return out.sortWithinPartitions("slot", "begin", "_uid").select(*(F.col("_row")[c].alias(c) for c in docs.columns))


ORACLE = f"""
WITH t AS (SELECT * FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^ \\n\\r\\t]+')) AS BIGINT) AS n,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS place FROM documents) WHERE n > 0),
s AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY source ORDER BY place, doc_id, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM t),
q AS (SELECT source, CAST(sum(n) AS BIGINT) AS total, CAST((sum(n) + {BLOCK_TOKENS - 1}) // {BLOCK_TOKENS} AS BIGINT) AS blocks, CAST(floor(sqrt(sum(n))) AS BIGINT) AS w FROM t GROUP BY source),
c AS (SELECT source, blocks, CAST((sum(w) OVER o - w) * {M} // (sum(w) OVER ()) AS BIGINT) AS lo, CAST(sum(w) OVER o * {M} // (sum(w) OVER ()) AS BIGINT) AS hi
  FROM q WINDOW o AS (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
i AS (SELECT slot, c.source, blocks, row_number() OVER (PARTITION BY c.source ORDER BY slot) - 1 AS r
  FROM (SELECT range AS slot, range % {M} * {PHI} % {M} AS u FROM range((SELECT CAST(sum(blocks) AS BIGINT) FROM q))) p JOIN c ON p.u >= c.lo AND p.u < c.hi),
a AS (SELECT slot, source, r % blocks AS block, CAST(r // blocks AS INT) AS epoch FROM i),
k AS (SELECT doc_id, source, b, n, unnest(range(b // {BLOCK_TOKENS}, (b + n - 1) // {BLOCK_TOKENS} + 1)) AS block FROM s)
SELECT a.slot, k.source, a.epoch, k.block, k.doc_id, greatest(b, k.block * {BLOCK_TOKENS}) - b AS first_token,
  least(b + n, (k.block + 1) * {BLOCK_TOKENS}) - greatest(b, k.block * {BLOCK_TOKENS}) AS n_tokens
FROM k JOIN a ON a.source IS NOT DISTINCT FROM k.source AND a.block = k.block
"""

__all__ = ["BLOCK_TOKENS", "ORACLE", "mix_sources", "mixed_documents", "n_tokens", "place", "schedule", "stored", "target_weights"]
