"""Benchmark decontamination with one FM-index per training shard.

A shard is a run of whole documents as word symbols: a separator after each document, one symbol for all words that no
benchmark item has, the benchmark's vocabulary beyond. Its suffix array (prefix doubling) gives the Burrows-Wheeler
transform, which is kept as a wavelet matrix with popcount ranks beside every 32nd suffix position. All test phrases
are searched backwards at once; occurrences are located through the sampled positions, and overlapping or touching
removal spans are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import doc_chunks, string_buffers, tidied, words_of

PHRASE_WORDS = 8
SHARD_BYTES = 8 << 20
SAMPLE = 32
#: Benchmark text shipped with a task at most; a larger benchmark is searched in several parts.
PART_BYTES = 32 << 20
#: With several parts, batches that are held at once while part after part is searched in them.
HELD_BYTES = 64 << 20

END, SEP, OTHER, FIRST = 0, 1, 2, 3


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of s, whose last symbol is unique and least; symbols take `bits` bits. Only tied suffixes are sorted again."""
    n, k = len(s), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([s, np.zeros(k, s.dtype)])
    for j in range(k):
        key <<= bits
        key |= padded[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.r_[True, key[1:] != key[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    todo = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = k
    while len(todo):
        at = sa[todo]
        nxt = at + h
        key = rank[at] * (n + 1) + np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[todo] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = todo[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        todo = todo[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


class Bits:
    """A bit vector with ranks: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before i."""
        w = i >> 6
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """Backward search and locating over a sequence of symbols below 2**bits that ends in END."""

    def __init__(self, s: np.ndarray, bits: int, sample: int = SAMPLE):
        sa = suffix_array(s, bits)
        bwt = s[sa - 1]
        self.n, self.bits = len(s), bits
        self.less = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << bits))])
        mark = (sa % sample == 0) | (sa == 0)
        self.marked, self.at = Bits(mark), sa[mark]
        self.levels: list[tuple[Bits, int]] = []
        for b in range(bits - 1, -1, -1):
            bit = (bwt >> b) & 1 == 1
            self.levels.append((Bits(bit), int(len(bwt) - np.count_nonzero(bit))))
            bwt = np.concatenate([bwt[~bit], bwt[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of symbol c in the transform before i."""
        s = np.zeros_like(i)
        for k, (v, zeros) in enumerate(self.levels):
            one = (c >> (self.bits - 1 - k)) & 1 == 1
            rs, ri = v.rank(s), v.rank(i)
            s, i = np.where(one, zeros + rs, s - rs), np.where(one, zeros + ri, i - ri)
        return i - s

    def last(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol of the transform at i, where the suffix with it before stands)."""
        c, at, s = np.zeros_like(i), i, np.zeros_like(i)
        for v, zeros in self.levels:
            one = v.get(at)
            ra, rs = v.rank(at), v.rank(s)
            at, s = np.where(one, zeros + ra, at - ra), np.where(one, zeros + rs, s - rs)
            c = (c << 1) | one
        return c, self.less[c] + at - s

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase; phrases are right-aligned rows."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for j in range(width - 1, -1, -1):
            live = live[lo[live] < hi[live]]
            now = live[lengths[live] >= width - j]
            if not len(now):
                break
            c = phrases[now, j]
            lo[now], hi[now] = self.less[c] + self.rank(c, lo[now]), self.less[c] + self.rank(c, hi[now])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at, steps, k = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(k):
            hit = self.marked.get(at)
            out[k[hit]] = self.at[self.marked.rank(at[hit])] + steps
            k, at = k[~hit], at[~hit]
            if len(k):
                _, at = self.last(at)
            steps += 1
        return out


class Phrases:
    """The benchmark as right-aligned rows of symbols: every window of n words of an item, a shorter item whole."""

    def __init__(self, texts: list[str], n: int = PHRASE_WORDS):
        raw, offsets = string_buffers(pa.array(texts, pa.string()))
        h, _, _, first = words_of(raw, offsets)
        self.vocab, sym = np.unique(h, return_inverse=True)
        rows = set()
        for a, b in zip(first[:-1], first[1:]):
            w = (sym[a:b] + FIRST).tolist()
            rows |= {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
        rows = sorted(rows)
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.rows = np.array([(0,) * (n - len(r)) + r for r in rows], np.int64).reshape(len(rows), n)
        self.bits = max(2, int(FIRST + len(self.vocab) - 1).bit_length())

    def symbols(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + FIRST, OTHER)


def shard_spans(raw: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, word after the last) of the merged spans in a shard of documents, in order."""
    none = np.zeros(0, np.int64)
    h, _, _, first = words_of(raw, offsets)
    n_docs = len(offsets) - 1
    if not len(h) or not len(phrases.rows):
        return none, none, none
    at = np.arange(len(h)) + np.repeat(np.arange(n_docs), np.diff(first))
    s = np.full(len(h) + n_docs + 1, SEP, np.int64)
    s[at] = phrases.symbols(h)
    s[-1] = END
    index = FMIndex(s, phrases.bits)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    count = hi - lo
    if not count.sum():
        return none, none, none
    which = np.repeat(np.arange(len(lo)), count)
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + lo[which]
    begin = index.locate(rows)
    order = np.argsort(begin)
    begin, end = begin[order], (begin + phrases.lengths[which])[order]
    far = np.maximum.accumulate(end)  # a separator stands between documents, so spans of two never touch
    new = np.r_[True, begin[1:] > far[:-1]]
    begin, end = begin[new], far[np.r_[np.flatnonzero(new)[1:] - 1, len(far) - 1]]
    starts = first[:-1] + np.arange(n_docs)
    doc = np.searchsorted(starts, begin, "right") - 1
    return doc, begin - starts[doc], end - starts[doc]


def _parts(benchmark: DataFrame):
    """The items' texts, in as many parts as PART_BYTES asks for, one at a time: the driver never holds more. Null texts are left out."""
    texts = benchmark.select("text").where("text IS NOT NULL").distinct()
    n = int((texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // PART_BYTES) + 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for k in range(n):
        yield [r.text for r in (texts if n == 1 else texts.where(part == k)).collect()]


def _cut(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans (first, after last) and what stands between them."""
    raw, offsets = string_buffers(pa.array([text]), lower=False)
    _, starts, ends, _ = words_of(raw, offsets)
    data, out, at = raw.tobytes(), [], 0
    for a, b in spans:
        out.append(data[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, data[at:]]).decode()


def _groups(batches, most: int):
    """Lists of batches of at least `most` bytes, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _found(batches, k: int, parts: list, phrase_words: int):
    """Every batch with the spans of its rows, {row: [(first word, after the last)]}: those of all parts (broadcasts) in the texts of column k as they came, merged."""
    one = Phrases(parts[0].value, phrase_words) if len(parts) == 1 else None
    for group in _groups(batches, HELD_BYTES if one is None else 0):
        spans: list[dict[int, list[tuple[int, int]]]] = [{} for _ in group]
        for part in parts:
            phrases = Phrases(part.value, phrase_words) if one is None else one
            for batch, got in zip(group, spans):
                raw, offsets = string_buffers(batch.column(k))
                for a, b in doc_chunks(offsets, SHARD_BYTES):
                    for d, s, e in zip(*(x.tolist() for x in shard_spans(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], phrases))):
                        got.setdefault(d + a, []).append((s, e))
            if one is None:
                vars(part).pop("_value", None)  # read again from disk for the next group
        for batch, got in zip(group, spans):
            for d, found in got.items():
                merged: list[tuple[int, int]] = []
                for s, e in sorted(found):
                    if merged and s <= merged[-1][1]:
                        merged[-1] = merged[-1][0], max(merged[-1][1], e)
                    else:
                        merged.append((s, e))
                got[d] = merged
            yield batch, dict(sorted(got.items()))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """doc_id, start_word, end_word (after the last): every merged span; documents without any have no row.

    Words are runs of ASCII letters, digits and all non-ASCII characters, lower-cased. Null and empty texts, documents
    or items, have no words; an item shorter than a phrase is one whole phrase; repeated rows give repeated spans; a
    document is never cut between shards. An empty table on either side gives no rows.
    """
    schema = T.StructType([docs.select("doc_id").schema[0], T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())])
    parts = [docs.sparkSession.sparkContext.broadcast(x) for x in _parts(benchmark)]

    def run(batches):
        for batch, got in _found(batches, 1, parts, phrase_words):
            if got:
                row, start, end = zip(*((d, s, e) for d, spans in got.items() for s, e in spans))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["doc_id", "start_word", "end_word"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS) -> DataFrame:
    """docs with every span removed from text and n_chars brought up to date; all rows and columns stay.

    A document that is nothing but spans keeps its row with what stands outside them. Cases as in contaminated_spans.
    """
    schema, cols = docs.schema, docs.columns
    parts = [docs.sparkSession.sparkContext.broadcast(x) for x in _parts(benchmark)]

    def run(batches):
        k = cols.index("text")
        for batch, changed in _found(batches, k, parts, phrase_words):
            if not changed:
                yield batch
                continue
            rows = np.array(list(changed))
            new = [_cut(batch.column(k)[int(i)].as_py(), changed[int(i)]) for i in rows]
            mask = np.zeros(batch.num_rows, bool)
            mask[rows] = True
            put = {"text": pa.array(new, batch.column(k).type)}
            if "n_chars" in cols:
                put["n_chars"] = pa.array([len(t) for t in new]).cast(batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([pc.replace_with_mask(batch.column(i), pa.array(mask), put[c]) if c in put else batch.column(i) for i, c in enumerate(cols)], schema=batch.schema)

    return docs.mapInArrow(tidied(run), schema)


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
p AS (SELECT DISTINCT array_to_string(w[i:i + {PHRASE_WORDS - 1}], ' ') AS g FROM b, unnest(range(1, len(w) - {PHRASE_WORDS - 2})) AS u(i)),
g AS (SELECT doc_id, i - 1 AS s, array_to_string(w[i:i + {PHRASE_WORDS - 1}], ' ') AS g FROM d, unnest(range(1, len(w) - {PHRASE_WORDS - 2})) AS u(i)),
h AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {PHRASE_WORDS} THEN 1 ELSE 0 END AS n FROM g JOIN p USING (g)),
k AS (SELECT doc_id, s, sum(n) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM h)
SELECT doc_id, CAST(min(s) AS INT) AS start_word, CAST(max(s) + {PHRASE_WORDS} AS INT) AS end_word FROM k GROUP BY doc_id, island
"""
