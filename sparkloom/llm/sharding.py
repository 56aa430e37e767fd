"""Sharding over fixed virtual slots.

Records are hashed into thousands of slots once and for all. Bytes are aggregated per slot, and a versioned map says
which shard holds a slot. Rebalancing never rehashes records: it edits entries of the map, as a new version.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import scratch_root

SLOTS, SHARDS, TOLERANCE = 4096, 64, 0.02


def slot_of(slots: int = SLOTS) -> Column:
    """The slot of a record: of its doc_id, or where that is null, of its text; neither: of the empty string."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """slot, n_docs, n_bytes: at most `slots` rows; partial sums are formed before the shuffle. A null text has 0 bytes."""
    return docs.groupBy(slot_of(slots).alias("slot")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n_bytes"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 1: equal runs of slots."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(now: list[int], load: dict[int, int], shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """Edits (slot, from, to) that bring every shard to within tolerance of the mean where slots allow it.

    The fullest shard gives the largest slot that fits into the emptiest; a shard none of whose slots helps is left as
    it is. Ties: lower shard, lower slot. Works over the fixed number of slots, on the driver.
    """
    total = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(now):
        total[shard] += load.get(slot, 0)
        if load.get(slot, 0):
            held[shard].append((load[slot], slot))
    for x in held:
        x.sort(key=lambda p: (-p[0], p[1]))
    mean = sum(total) / shards
    full, edits = [(-total[s], s) for s in range(shards)], []
    heapq.heapify(full)
    while full:
        most, src = heapq.heappop(full)
        if -most != total[src]:
            continue
        if total[src] <= mean * (1 + tolerance):
            break
        dst = min(range(shards), key=lambda s: (total[s], s))
        gap = total[src] - total[dst]
        k = next((i for i, (n, _) in enumerate(held[src]) if n < gap and total[dst] + n <= mean * (1 + tolerance)), None)
        if k is None:
            continue
        n, slot = held[src].pop(k)
        held[dst].append((n, slot))
        held[dst].sort(key=lambda p: (-p[0], p[1]))
        total[src] -= n
        total[dst] += n
        edits.append((slot, src, dst))
        heapq.heappush(full, (-total[src], src))
        if total[dst] > mean * (1 + tolerance):
            heapq.heappush(full, (-total[dst], dst))
    last: dict[int, tuple[int, int]] = {}
    for slot, src, dst in edits:
        last[slot] = (last.get(slot, (src, dst))[0], dst)
    return [(slot, a, b) for slot, (a, b) in sorted(last.items()) if a != b]


class SlotMap:
    """Versions of the slot-to-shard map, each a folder version=N of (slot, shard) rows; versions are never changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def store(self, version: int, shards: list[int]) -> None:
        self.spark.createDataFrame(list(enumerate(shards)), "slot int, shard int").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.path}/version={version}")

    def versions(self) -> list[int]:
        hpath = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hpath.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName().partition("=")[2]) for x in fs.listStatus(hpath) if x.getPath().getName().startswith("version=")) if fs.exists(hpath) else []

    def edit(self, load: dict[int, int], shards: int, tolerance: float = TOLERANCE) -> int:
        """Rebalances the newest version; returns the version then valid."""
        version = self.versions()[-1]
        now = [r.shard for r in self.load(version).orderBy("slot").collect()]
        edits = rebalanced(now, load, shards, tolerance)
        if not edits:
            return version
        for slot, _, shard in edits:
            now[slot] = shard
        self.store(version + 1, now)
        return version + 1


def shard_documents(docs: DataFrame, slots: int = SLOTS, shards: int = SHARDS, tolerance: float = TOLERANCE, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, slot, shard, map_version for every row of docs.

    The map is stored under path (default: a new one in the shared folder): version 1, then the edited version. Repeated
    rows share a slot; null and empty texts have 0 bytes; an empty table gives no rows and version 1 only.
    """
    spark = docs.sparkSession
    slot_map = SlotMap(spark, path or f"{scratch_root(spark)}/loom-slots-{uuid.uuid4().hex}")
    if not slot_map.versions():
        slot_map.store(1, first_map(slots, shards))
    load = {r.slot: r.n_bytes for r in slot_bytes(docs, slots).collect()}  # at most `slots` rows, at any size
    version = slot_map.edit(load, shards, tolerance)
    out = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), slot_of(slots).alias("slot"))
    return out.join(F.broadcast(slot_map.load(version)), "slot").select("doc_id", "n_bytes", "slot", "shard", F.lit(version).alias("map_version"))
