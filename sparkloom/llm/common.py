"""Pieces that the corpus operators share: scratch storage, word hashing over Arrow buffers."""

from __future__ import annotations

import ctypes
import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import forget as drop_stored
from sparkloom.session import scratch as scratch_root
from sparkloom.session import stored

#: Rows times bytes up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Text handled at once inside a Python worker; a single longer document is handled whole.
CHUNK_BYTES = 2 << 20
HASH_BLOCK = 1 << 19


@functools.lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on, idle, while the JVM beside it needs the room."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidied(run):
    """run, a function from batches to batches, with release() at its task's end."""

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as it takes to be none of the column names in taken."""
    there = {c.lower() for c in taken}
    while name.lower() in there:
        name = "_" + name
    return name


def integer_ids(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """df with its id as a 64-bit integer; TypeError for a column of another kind."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} must be an integer column, not {kind.simpleString()}")
    return df if isinstance(kind, T.LongType) else df.withColumn(column, F.col(column).cast("long"))


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has few enough rows, else df unchanged, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def spread(spark: SparkSession, rows: int, per_part: int) -> int:
    """Number of partitions for so many rows, at least the session's parallelism."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / per_part))


def string_buffers(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges (a, b) of documents holding at most `most` bytes, one document at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


_IS_WORD = np.zeros(256, bool)
_IS_WORD[128:] = True
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        x = np.full(max(n, 2 * HASH_BLOCK), np.uint64(base))
        x[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(x)
    return have


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_spans(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes; none crosses a document."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = np.zeros(n + 2, bool)
    w[1:-1] = table[raw]
    edge = w[1:] != w[:-1]  # edge[i]: a run starts or ends before byte i
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < n)])
    cut = cut[w[cut] & w[cut + 1]]  # a run goes over the border of two documents
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs (in order of their starts), by prefix sums of a polynomial over blocks of the buffer."""
    out = np.zeros(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        at = int(starts[k])
        m = int(np.searchsorted(starts, at + HASH_BLOCK, "left"))
        s, e = starts[k:m] - at, ends[k:m] - at
        n = int(e[-1])
        c = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw[at : at + n]] * _powers(_BASE, n)[:n], out=c[1:])
        h = (c[e] - c[s]) * _powers(_INV, int(s[-1]) + 1)[s]
        out[k:m] = mix64(h ^ ((e - s).astype(np.uint64) << np.uint64(56)))
        k = m
    return out


def words_of(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first): word k of document d is at first[d] + k."""
    starts, ends = word_spans(raw, offsets, table)
    return span_hashes(raw, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def hash_words(words: list[str]) -> np.ndarray:
    """The same hashes for a list of single words."""
    raw, offsets = string_buffers(pa.array(words, pa.string()))
    return span_hashes(raw, offsets[:-1], offsets[1:])


__all__ = ["drop_stored", "scratch_root", "stored"]
