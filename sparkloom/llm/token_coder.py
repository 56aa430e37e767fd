"""Token ids as compressed binary blocks: adaptive context mixing and a range coder.

Texts become ids of a public tokenizer. The ids of a task, document after document, are cut into blocks of equally many,
and every block is coded on its own: its models start anew and a checksum guards it. For each id three models speak:
orders 2 and 1 name the id that last followed the same two or one ids, order 0 gives the adaptive frequencies of all
ids. The three are mixed with weights that are learned, within the block, for each state of confidence (how often each
context was met and how long it has been right); the mixture is one interval for the range coder.

Frequencies and weights are refreshed at fixed places of a block, so that the encoder computes the intervals of a whole
block at once; the blocks of a task are then coded side by side. The decoder rebuilds the same models id by id.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkloom.llm.common import doc_chunks, integer_ids, span_hashes, string_buffers, tidied

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 1 << 14
#: Text tokenized at once, and blocks coded side by side.
TEXT_BYTES, LANES = 1 << 20, 256
#: Distinct pieces that a worker remembers; beyond it starts anew, which costs time only.
PIECES = 1 << 19
#: Bits of the coder's total; the least share of order 0, which every id has; how much one occurrence adds to its frequency.
TOTAL_BITS, LEAST, GAIN = 26, 1 << 21, 32
TOTAL = 1 << TOTAL_BITS

SCHEMA = "doc_ids array<long>, first_tokens array<long>, n_tokens array<int>, block_tokens int, raw_bytes long, crc32 long, payload binary"


# ---- text to ids ----

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space beyond ASCII, and controls of which libraries differ: such documents are tokenized whole.
_RARE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Tokenizer:
    """Ids of whole texts. A text falls apart, without effect on the ids, before a single space between other characters
    and around such a line feed; each distinct piece is encoded once a task. Pieces are found by their hashes; the bytes of
    the ids are then compared with the text, and a document in which they differ is encoded as a whole."""

    def __init__(self, path: str = TOKENIZER):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.n_ids = max(ranks.values()) + 1
        text = [b""] * self.n_ids
        for piece, k in ranks.items():
            text[k] = piece
        self.text = np.frombuffer(b"".join(text), np.uint8)  # the bytes of every id
        self.size = np.array([len(x) for x in text], np.int32)
        self.at = np.cumsum(self.size, dtype=np.int32) - self.size
        self.one = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted; their ids are many[k] from begin[k]
        self.begin, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        got = [self.one.encode_ordinary(p) for p in pieces]
        many = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(many.sum()))
        to = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, to, keys)
        self.begin = np.insert(self.begin, to, len(self.ids) + np.cumsum(many) - many)
        self.many = np.insert(self.many, to, many)
        self.ids = np.concatenate([self.ids, flat])

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids before each document and in all)."""
        n_docs = len(offsets) - 1
        if len(self.keys) > PIECES:
            self._forget()
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n_docs + 1, np.int64)
        space = _ASCII_SPACE[raw]
        cut = np.zeros(len(raw) + 1, bool)
        inner = ~space[:-2] & ~space[2:]
        cut[1:-2] |= inner & (raw[1:-1] == 32)
        feed = inner & (raw[1:-1] == 10)
        cut[1:-2] |= feed
        cut[2:-1] |= feed
        for m in _RARE.finditer(raw.tobytes()):
            d = int(np.searchsorted(offsets, m.start(), "right")) - 1
            cut[offsets[d] : offsets[d + 1]] = False
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.concatenate([starts[1:], [len(raw)]])
        keys = span_hashes(raw, starts, ends)
        distinct, which = np.unique(keys, return_inverse=True)
        fresh = np.flatnonzero(~np.isin(distinct, self.keys, assume_unique=True))
        if len(fresh):
            some = np.empty(len(distinct), np.int64)
            some[which] = np.arange(len(keys))  # where a distinct piece stands
            data, some = raw.tobytes(), some[fresh]
            self._learn(distinct[fresh], [data[a:b].decode() for a, b in zip(starts[some].tolist(), ends[some].tolist())])
        at = np.searchsorted(self.keys, distinct)[which]
        size = self.many[at]
        ids = self.ids[_ranges(self.begin[at], size)]
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, offsets)]
        return (ids, upto) if self.spells(ids, raw) else self._mended(ids, upto, raw, offsets)

    def spells(self, ids: np.ndarray, raw: np.ndarray) -> bool:
        """Whether the ids are those bytes."""
        step = 1 << 22  # ids at once, whose places are then 32-bit integers
        place = 0
        for a in range(0, len(ids), step):
            size = self.size[ids[a : a + step]]
            got = self.text[_ranges(self.at[ids[a : a + step]], size)]
            if not np.array_equal(got, raw[place : place + len(got)]):
                return False
            place += len(got)
        return place == len(raw)

    def _mended(self, ids: np.ndarray, upto: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = []
        for i, j, a, b in zip(upto, upto[1:], offsets, offsets[1:]):
            own, text = ids[i:j], raw[a:b]
            got.append(own if self.spells(own, text) else np.array(self.one.encode_ordinary(text.tobytes().decode()), np.int32))
        return np.concatenate(got), np.concatenate([[0], np.cumsum([len(x) for x in got])])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, .., of size[0], then those of the next."""
    upto = np.cumsum(size, dtype=size.dtype)
    out = np.arange(upto[-1] if len(upto) else 0, dtype=size.dtype)
    out += np.repeat(begin - upto + size, size)
    return out


# ---- models ----


def refreshes(n: int) -> list[int]:
    """Places of a block at which frequencies and weights are brought up to date: powers of two, later every 4096."""
    out, at = [], 128
    while at < n:
        out.append(at)
        at = 2 * at if at < 4096 else at + 4096
    return [0, *out, n]


#: Confidence of an order: 0 for a context not met before, else by the run of right predictions (0, 1, 2, 3 or more), met once or more.
STATES = 9
_START = np.array([[1 + 3 * a + (b > 0), 1 + 3 * b, 8] for a in range(STATES) for b in range(STATES)], np.int64)


def _state(met: np.ndarray, run: np.ndarray) -> np.ndarray:
    return np.where(met == 0, 0, 1 + np.minimum(run, 3) + 4 * (met > 1))


def _weights(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(share of order 2, share of order 1) of TOTAL for each pair of states; counts of hits of 2, of 1, and misses of both."""
    rest = TOTAL - LEAST
    total = counts.sum(1)
    return rest * counts[:, 0] // total, rest * counts[:, 1] // total


def _predict(ctx: np.ndarray, x: np.ndarray, ok: int) -> tuple[np.ndarray, np.ndarray]:
    """(the id that last followed the same context, -1 for none; state of confidence) for every place; the first ok have none."""
    n = len(x)
    guess, state = np.full(n, -1, np.int32), np.zeros(n, np.int64)
    if n <= ok:
        return guess, state
    key = (ctx[ok:] << 16) | np.arange(ok, n)
    key.sort()
    t, c = key & 0xFFFF, key >> 16
    k = np.arange(len(t))
    same = np.zeros(len(t), bool)
    same[1:] = c[1:] == c[:-1]
    y = x[t]
    hit = np.zeros(len(t), bool)
    hit[1:] = same[1:] & (y[1:] == y[:-1])
    first = np.maximum.accumulate(np.where(same, 0, k))
    miss = np.maximum.accumulate(np.where(hit, 0, k))
    run = np.zeros(len(t), np.int64)
    run[1:] = (k - miss)[:-1]
    state[t] = _state(k - first, run)
    guess[t[1:]] = np.where(same[1:], y[:-1], -1)
    return guess, state


def intervals(x: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin, width) out of TOTAL of every id of a block."""
    n, wide = len(x), x.astype(np.int64)
    c1 = np.zeros(n, np.int64)
    c1[1:] = wide[:-1]
    c2 = np.zeros(n, np.int64)
    c2[2:] = (wide[:-2] << 16) | wide[1:-1]
    g1, s1 = _predict(c1, x, 1)
    g2, s2 = _predict(c2, x, 2)
    hit2 = g2 == x
    hit1 = g1 == x
    pair = s2 * STATES + s1
    event = pair * 3 + np.where(hit2, 0, np.where(hit1, 1, 2))
    counts = _START.copy()
    freq, upto = np.ones(n_ids, np.int64), np.zeros(n_ids + 1, np.int64)
    begin, width = np.empty(n, np.int64), np.empty(n, np.int64)
    at = refreshes(n)
    for a, b in zip(at, at[1:]):
        w2, w1 = _weights(counts)
        p, s = pair[a:b], wide[a:b]
        m2, m1 = np.where(g2[a:b] >= 0, w2[p], 0), np.where(g1[a:b] >= 0, w1[p], 0)
        w0 = TOTAL - m2 - m1
        np.cumsum(freq, out=upto[1:])
        total = int(upto[-1])
        lo = upto[s] * w0 // total
        begin[a:b] = lo + np.where(g2[a:b] < s, m2, 0) + np.where(g1[a:b] < s, m1, 0)
        width[a:b] = upto[s + 1] * w0 // total - lo + np.where(hit2[a:b], m2, 0) + np.where(hit1[a:b], m1, 0)
        counts += np.bincount(event[a:b], minlength=STATES * STATES * 3).reshape(-1, 3)
        np.add.at(freq, s, GAIN)
    return begin.astype(np.uint32), width.astype(np.uint32)


# ---- range coder: 64-bit state, 32-bit digits, no carries ----

_FULL, _DIGIT = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def code(parts: Iterable[tuple[np.ndarray, np.ndarray]], sizes: list[int] | None = None) -> list[bytes]:
    """Codes blocks side by side, one a lane. With their sizes given, the intervals of one block at a time are asked for."""
    if sizes is None:
        parts = list(parts)
        sizes = [len(b) for b, _ in parts]
    size, n = np.array(sizes), len(sizes)
    order = np.argsort(-size, kind="stable")
    lane = np.empty(n, np.int64)
    lane[order] = np.arange(n)
    longest = int(size.max())
    begin = np.zeros((longest, n), np.uint32)
    width = np.zeros((longest, n), np.uint32)
    for k, part in enumerate(parts):
        begin[: size[k], lane[k]], width[: size[k], lane[k]] = part
    active = n - np.searchsorted(size[order][::-1], np.arange(longest), "right")
    low, span = np.zeros(n, np.uint64), np.full(n, _FULL)
    out = np.zeros((longest + 2, n), np.uint32)
    used = np.zeros(n, np.int64)
    shift = np.uint64(TOTAL_BITS)
    for t in range(longest):
        m = int(active[t])
        lo, sp = low[:m], span[:m]
        r = sp >> shift
        lo += r * begin[t, :m]
        np.multiply(r, width[t, :m], out=sp)
        k = np.flatnonzero(sp <= _LOW)
        if len(k):
            a, w = lo[k], sp[k]
            over = ((a ^ (a + w - np.uint64(1))) >> _DIGIT) != 0
            w = np.where(over, (~a & _LOW) + np.uint64(1), w)
            out[used[k], k] = (a >> _DIGIT).astype(np.uint32)
            used[k] += 1
            lo[k], sp[k] = a << _DIGIT, w << _DIGIT
    lanes = np.arange(n)
    for digit in (low >> _DIGIT, low & _LOW):
        out[used, lanes] = digit.astype(np.uint32)
        used += 1
    return [out[: used[at], at].astype(">u4").tobytes() for at in lane]


def decode(payload: bytes, n: int, n_ids: int) -> np.ndarray:
    """The ids of one block, one by one with the encoder's models."""
    digits = [*np.frombuffer(payload, ">u4").tolist(), 0, 0]
    value, pos, low, span = (digits[0] << 32) | digits[1], 2, 0, (1 << 64) - 1
    x: list[int] = []
    last: tuple[dict, dict] = ({}, {})  # context: [id, met, run]
    counts, freq, at, events = _START.copy(), np.ones(n_ids, np.int64), refreshes(n), []
    for a, b in zip(at, at[1:]):
        w2s, w1s = (w.tolist() for w in _weights(counts))
        upto = np.concatenate([[0], np.cumsum(freq)])
        total = int(upto[-1])
        for t in range(a, b):
            ctx = ((x[t - 2] << 16) | x[t - 1] if t > 1 else None, x[t - 1] if t else None)
            found = [last[j].get(c) if c is not None else None for j, c in enumerate(ctx)]
            s2, s1 = (0 if f is None else 1 + min(f[2], 3) + 4 * (f[1] > 1) for f in found)
            g2, g1 = (-1 if f is None else f[0] for f in found)
            pair = s2 * STATES + s1
            m2, m1 = w2s[pair] if g2 >= 0 else 0, w1s[pair] if g1 >= 0 else 0
            w0 = TOTAL - m2 - m1
            r = span >> TOTAL_BITS
            target = min((value - low) // r, TOTAL - 1)

            def start(s):
                return int(upto[s]) * w0 // total + m2 * (0 <= g2 < s) + m1 * (0 <= g1 < s)

            lo, hi = 0, n_ids - 1
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if start(mid) <= target else (lo, mid - 1)
            begin = start(lo)
            width = int(upto[lo + 1]) * w0 // total - int(upto[lo]) * w0 // total + m2 * (g2 == lo) + m1 * (g1 == lo)
            low, span = low + r * begin, r * width
            if span <= 0xFFFFFFFF:
                if (low ^ (low + span - 1)) >> 32:
                    span = (~low & 0xFFFFFFFF) + 1
                low, span = (low << 32) & ((1 << 64) - 1), span << 32
                value = ((value << 32) & ((1 << 64) - 1)) | digits[min(pos, len(digits) - 1)]
                pos += 1
            x.append(lo)
            events.append(pair * 3 + (0 if g2 == lo else 1 if g1 == lo else 2))
            for j, c in enumerate(ctx):
                if c is not None:
                    f = last[j].get(c)
                    last[j][c] = [lo, 1, 0] if f is None else [lo, f[1] + 1, f[2] + 1 if f[0] == lo else 0]
        counts += np.bincount(events, minlength=STATES * STATES * 3).reshape(-1, 3)
        events = []
        np.add.at(freq, x[a:b], GAIN)
    return np.array(x, np.int32)


def checked(block: dict, n_ids: int) -> np.ndarray:
    """The ids of a block, or ValueError if they don't agree with its checksum."""
    x = decode(block["payload"], block["block_tokens"], n_ids)
    if zlib.crc32(x.astype("<u4").tobytes()) != block["crc32"]:
        raise ValueError("a block of token ids is damaged")
    return x


@lru_cache(1)
def _tokenizer(path: str) -> Tokenizer:
    """The tokenizer in a task: the vocabulary file that the driver sent along, else the one at the path."""
    sent = SparkFiles.get(os.path.basename(path))
    return Tokenizer(sent if os.path.exists(sent) else path)


def _send(spark: SparkSession, path: str) -> None:
    if os.path.exists(path):
        spark.sparkContext.addFile(path)


def token_blocks(docs: DataFrame, tokenizer: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each block: the pieces of documents in it (doc_ids, first_tokens, n_tokens), its number of ids and their
    bytes as 32-bit integers, the ids' CRC-32 and the coded payload.

    Documents follow each other as in their partition, so the order of docs is kept; a long document goes on in the next
    block. A null or empty text has one piece without ids; a null doc_id stays null; repeated rows are coded again. A task
    without rows gives no block, nor does an empty table. Other columns are ignored; doc_id must be an integer column.
    block_tokens is at most 65536.
    """
    if not 0 < block_tokens <= 1 << 16:
        raise ValueError("block_tokens must be from 1 to 65536")
    _send(docs.sparkSession, tokenizer)

    def run(batches):
        tok = _tokenizer(tokenizer)
        ids = np.zeros(0, np.int32)
        pieces: list[list] = [[]]  # of the block that is being filled
        room, full, blocks = block_tokens, [], []

        def out():
            coded = code((intervals(b, tok.n_ids) for b in blocks), list(map(len, blocks))) if blocks else []
            rows = [(*map(list, zip(*p)), len(b), 4 * len(b), zlib.crc32(b.astype("<u4").tobytes()), c) for p, b, c in zip(full, blocks, coded)]
            full.clear()
            blocks.clear()
            cols = list(zip(*rows))
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1), lower=False)
            names = batch.column(0).to_pylist()
            for a, b in doc_chunks(offsets, TEXT_BYTES):
                got, upto = tok.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.concatenate([ids, got])
                for d, size in zip(names[a:b], np.diff(upto).tolist()):
                    first = 0
                    while True:
                        take = min(room, size - first)
                        pieces[0].append((d, first, take))
                        first, room = first + take, room - take
                        if not room:
                            full.append(pieces[0])
                            pieces[0], room = [], block_tokens
                        if first >= size:
                            break
                k = len(full) - len(blocks)
                blocks += [ids[i * block_tokens : (i + 1) * block_tokens] for i in range(k)]
                ids = ids[k * block_tokens :]
                if len(blocks) >= LANES:
                    yield out()
        if pieces[0]:
            full.append(pieces[0])
            blocks.append(ids)
        if blocks:
            yield out()

    return integer_ids(docs).select("doc_id", "text").mapInArrow(tidied(run), SCHEMA)


def documents_of(blocks: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, first_token, ids) of every piece of a document: the way back, with every checksum compared."""
    _send(blocks.sparkSession, tokenizer)

    def run(batches):
        n_ids = _tokenizer(tokenizer).n_ids
        for batch in batches:
            for row in batch.to_pylist():
                x = checked(row, n_ids)
                at = np.cumsum([0, *row["n_tokens"]])
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["first_tokens"], pa.int64()), pa.array([x[i:j].tolist() for i, j in zip(at, at[1:])], pa.list_(pa.int32()))], names=["doc_id", "first_token", "ids"])

    return blocks.mapInArrow(tidied(run), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("first_token", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]))
