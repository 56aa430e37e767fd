"""Connected components of an edge table by alternating large and small stars; every round is written to the shared folder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_stored, stored, tidied

#: Edges of a task that are looked at together before the first round.
AT_ONCE = 1 << 20


class Forest:
    """Sets of the numbers below n that are joined one after the other."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether they weren't joined yet. The lesser root stays one."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def _thinned(batches):
    """Of every AT_ONCE edges of a task those that connect the same ids: fewer than there are ids."""
    parts, held = [], 0

    def out():
        a, b = (np.concatenate(x) for x in zip(*parts))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        keep = np.array([forest.join(i, j) for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist())], bool)
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held >= AT_ONCE:
            yield out()
            parts, held = [], 0
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every id in the edges (a, b), label the least id of its component. Nulls and loops must be left out.

    Rounds go on until nothing changes, which takes about the square of the logarithm of the edges at most.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = edges.select("a", "b").mapInArrow(tidied(_thinned), "a long, b long")
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above a node go to its least neighbour
        m = both(now).groupBy("a").agg(F.min("b").alias("m"))
        least = m.select("a", F.least("a", "m").alias("m"))
        large = both(now).join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its lower neighbours go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        nxt = stored(small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        same = nxt.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        drop_stored(now)
        now = nxt
        if same == before:
            break
        before = same
    return now.select(F.col("a").alias("id"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("label"))).distinct()
