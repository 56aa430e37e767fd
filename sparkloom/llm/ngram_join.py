"""Self-join of documents on the Jaccard similarity of their word n-gram sets, by adaptive multi-match prefixes.

Tokens (n-grams) have one global order: those found often come last, by their count; the rest goes by how often their words
would meet by chance, and by hash. If two sets
of Jaccard at least t share o tokens, then o >= ceil(t * size) for either, so that their first size - ceil(t * size) + l
tokens share l of them, for any l. Each document takes the l that makes its estimated cost least: lists to scan, and
candidates left to verify, which l more required matches thin out. A pair is a candidate if it shares l tokens within
both prefixes of that length, l the lesser of the two. A token that very many sets have is searched in blocks of pairs of
parts, so that no task gets its whole list. Candidates are verified on whole sets. A set is shipped once, to the bucket of
its cluster; a cluster of very many sets is split into parts, and its pairs go to the blocks of two parts. Equal sets are
one set until the end.

Many near copies of one text meet in as many lists as their prefixes share tokens, so that the pairs of these lists grow with
the square of the copies, many times over. Sets that share long lists therefore form a clump: within it all pairs are compared
at once, exactly, as products of blocks of the matrix of sets and tokens, and lists give only pairs of different clumps. Which
sets form a clump decides about time alone: every pair is met either in its clump or through lists.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from sparkloom.llm.common import doc_chunks, free_name, integer_ids, mix64, release, small, spread, stored, string_buffers, tidied, words_of
from sparkloom.llm.components import Forest, components
from sparkloom.session import forget

NGRAM, THRESHOLD, LONGEST = 3, 0.6, 8
#: Tokens whose place in the order goes by count: the most frequent ones. It bounds what is shipped, never what is found.
ORDERED, LOCAL_MIN = 1 << 20, 3
COUNT_TOKENS = 2 << 20
PAIRS_AT_ONCE = 1 << 20
#: Sets of one token, and of one cluster, that stay together; beyond it they are split into parts of about as many.
HOT, BLOCK_SETS = 1 << 15, 2000
#: Bytes of each partition's first texts whose words are counted, and places that they are counted by, for the order of tokens
#: that aren't counted themselves.
SAMPLED, PLACES = 1 << 19, 1 << 20
#: Tokens compared at once when pairs are verified.
GATHERED = 1 << 20
#: Sets of a list from which on its sets form clumps; tokens of a part of a clump; columns of the matrix multiplied at once.
LONG, PART_TOKENS, COLUMNS = 32, 1 << 20, 1 << 10

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int, rare: np.ndarray | None = None) -> list:
    """The sorted n-gram hashes of each document; a shorter document is one gram, an empty one has none. With rare (see
    rarity), pairs of the hashes and the sums of their words' rarities."""
    h, _, _, first = words_of(raw, offsets)
    k = len(h)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    mixed = np.zeros(k, np.uint64)
    for j in range(n):
        mixed += mix64(padded[j : j + k] + _C[j % 8]) * _C[(j + 3) % 8]
    mixed = mix64(mixed)
    if rare is not None:
        own = np.concatenate([rare[_place(h)], np.zeros(n, rare.dtype)])
        total = np.sum([own[j : j + k] for j in range(n)], axis=0, dtype=np.int64)
    out: list = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n and rare is not None:
            x = mixed[a : b - n + 1]
            order = np.argsort(x)
            x = x[order]
            new = np.r_[True, x[1:] != x[:-1]]
            out.append((x[new], total[a : b - n + 1][order[new]]))
        elif b - a >= n:
            x = np.sort(mixed[a : b - n + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif b > a:
            x = np.zeros(1, np.uint64)
            for j in range(n):
                x += mix64((h[a + j : a + j + 1] if a + j < b else np.zeros(1, np.uint64)) + _C[j % 8]) * _C[(j + 3) % 8]
            out.append(mix64(x) if rare is None else (mix64(x), own[a:b].sum(keepdims=True, dtype=np.int64)))
        else:
            out.append(np.zeros(0, np.uint64) if rare is None else (np.zeros(0, np.uint64), total[:0]))
    return out


def set_names(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two independent 64-bit names of a set; equal sets have equal names. The first has only so many bits in tests."""
    size = np.array([len(s)], np.uint64)
    x = mix64(s ^ _C[5]).sum(dtype=np.uint64) ^ mix64(size)[0]
    y = mix64(mix64(s + _C[6]) ^ _C[7]).sum(dtype=np.uint64) ^ mix64(size + _C[2])[0]
    return int((x >> np.uint64(64 - bits)).astype(np.int64)), int(y.astype(np.int64))


class Names:
    """The one name of a set: the first, or where different sets share that (`clashing`), the second."""

    def __init__(self, clashing: frozenset[int] = frozenset(), bits: int = 64):
        self.clashing, self.bits = clashing, bits

    def of(self, s: np.ndarray) -> int:
        x, y = set_names(s, self.bits)
        return y if x in self.clashing else x


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)


def rarity(prof: DataFrame) -> np.ndarray:
    """-8 log2 of the share of all words that those of each place have, in the sampled texts. Any values give the same
    results: they decide about the order of tokens, and so about time, alone."""
    found = prof.where("place IS NOT NULL").groupBy("place").agg(F.sum("times").alias("n")).toArrow()
    n = np.full(PLACES, 0.5)
    n[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return np.round(-8 * np.log2(n / n.sum())).astype(np.int16)


def _each(batches, column: int, n: int, rare: np.ndarray | None = None):
    """(batch, row, set) of every row."""
    for batch in batches:
        raw, offsets = string_buffers(batch.column(column))
        for a, b in doc_chunks(offsets):
            for d, s in enumerate(gram_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n, rare)):
                yield batch, a + d, s


def profile(docs: DataFrame, n: int = NGRAM, bits: int = 64) -> tuple[DataFrame, Names]:
    """One table of three kinds of rows: (uid, doc_id, set_id, size) of each document, set_id null if it has no words, (token,
    found) of the tokens that LOCAL_MIN distinct sets of about COUNT_TOKENS tokens have, counted over all documents, and
    (place, times) of the words of some documents.

    First names that differing sets share are looked for over all documents and sent to the driver: about 70 among
    5 * 10^10 documents.
    """

    columns = ["uid", "doc_id", "set_id", "other", "size", "token", "found", "place", "times"]

    def run(batches):
        batches = iter(batches)
        uid, heap, held, seen = TaskContext.get().partitionId() << 40, [], 0, set()
        rows: list[tuple] = []

        def flush():
            nonlocal heap, held, seen, rows
            tokens, counts = np.unique(np.concatenate(heap), return_counts=True) if heap else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = counts >= LOCAL_MIN
            tokens, counts, k = tokens[often], counts[often], len(rows)
            z = pa.nulls(len(tokens), pa.int64())
            cols = [pa.concat_arrays([pa.array([r[i] for r in rows], pa.int64()), z]) for i in range(5)]
            cols += [pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(x.astype(np.int64))]) for x in (tokens, counts)]
            cols += [pa.nulls(k + len(tokens), pa.int64())] * 2
            heap, held, seen, rows = [], 0, set(), []
            return pa.RecordBatch.from_arrays(cols, columns)

        def words(batch):
            raw, offsets = string_buffers(batch.column(1))
            few = next(doc_chunks(offsets, SAMPLED))[1] if len(offsets) > 1 else 0
            place, times = np.unique(_place(words_of(raw[: offsets[few]], offsets[: few + 1])[0]), return_counts=True)
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(place), pa.int64())] * 7, pa.array(place), pa.array(times)], columns)

        first = next(batches, None)
        if first is None:
            return
        yield words(first)
        batches = chain([first], batches)

        for batch, row, s in _each(batches, 1, n):
            name, other = set_names(s, bits) if len(s) else (None, None)
            rows.append((uid, batch.column(0)[row].as_py(), name, other, len(s)))
            uid += 1
            if len(s) and other not in seen:
                seen.add(other)
                heap.append(s)
                held += len(s)
            if held >= COUNT_TOKENS or len(rows) >= 1 << 18:
                yield flush()
        if rows:
            yield flush()

    raw = stored(integer_ids(docs).select("doc_id", "text").mapInArrow(tidied(run), ", ".join(f"{c} long" for c in columns)), "profile")
    shared = raw.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("other").alias("x"), F.max("other").alias("y")).where("x <> y").select("set_id")
    names = Names(frozenset(r.set_id for r in shared.collect()), bits)
    one = F.when(F.col("set_id").isin(sorted(names.clashing)), F.col("other")).otherwise(F.col("set_id")) if names.clashing else F.col("set_id")
    return raw.withColumn("set_id", one).drop("other"), names


def frequent(prof: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ORDERED most frequent tokens, sorted, and their counts: 16 bytes each, at any size of the corpus."""
    top = prof.where("token IS NOT NULL").groupBy("token").agg(F.sum("found").alias("found")).orderBy(F.desc("found"), "token").limit(ORDERED)
    t = top.toArrow()
    tokens, found = t.column("token").to_numpy().astype(np.uint64), t.column("found").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], found[order]


def least_overlap(size: int, t: float) -> int:
    return max(1, int(np.ceil(t * size - 1e-9)))


def prefix(s: np.ndarray, tokens: np.ndarray, found: np.ndarray, t: float, longest: int = LONGEST, likely: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """(tokens of the document's prefix, the l from which each is in it, the document's l, the tokens' counts, which are no
    less than what is likely)."""
    size = len(s)
    df = np.zeros(size) if likely is None else likely
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
        df = np.where(tokens[at] == s, np.maximum(found[at], df), df)
    order = np.argsort(df, kind="stable")
    s, df = s[order], df[order]
    need = least_overlap(size, t)
    base = size - need + 1
    most = min(longest, need)
    cost_of = np.maximum(df[: base + most - 1], 1.3)  # lists to scan; tokens that aren't counted have few partners
    scan = np.cumsum(cost_of)
    ells = np.arange(1, most + 1)
    cost = scan[base - 1 + ells - 1] + size * (np.cumsum(cost_of - 1)[base - 1 + ells - 1] / ells**2)
    ell = int(ells[np.argmin(cost)])
    k = base + ell - 1
    return s[:k], np.maximum(1, np.arange(k) - base + 2), ell, df[:k]


def split_hot(tok: np.ndarray, meta: np.ndarray, df: np.ndarray, name: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """tok and meta with a token of more than `hot` sets once for each pair of parts that the set's part is in."""
    many = np.flatnonzero(df > hot)
    if not len(many):
        return tok, meta
    rest = np.setdiff1d(np.arange(len(tok)), many)
    toks, metas = [tok[rest]], [meta[rest]]
    for i in many.tolist():
        k = -(-int(df[i]) // hot)
        own, other = int(name % k), np.arange(k)
        lo, hi = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
        toks.append(mix64(mix64(tok[i] ^ (lo * _C[0] + _C[1])) ^ (hi * _C[2] + _C[3])))
        metas.append(meta[i] | np.where(other == own, 0, np.where(other > own, 1, 2)))
    return np.concatenate(toks), np.concatenate(metas)


def chances(n: int, words: int, found: np.ndarray) -> np.ndarray:
    """In how many sets a token is likely to be by chance, by the sum of its words' rarities, in a corpus of so many words; at
    most as many as would have been counted."""
    most = max(LOCAL_MIN * words / COUNT_TOKENS, LOCAL_MIN, found.min() if len(found) == ORDERED else 0)
    return np.minimum(most, words * np.exp2(-np.arange(n * 8 * 64 + 1) / 8))


def prefixes(docs: DataFrame, tokens, found, names: Names, n: int, t: float, hot: int = HOT, rare: np.ndarray | None = None, words: int = 0) -> DataFrame:
    """(token, set_id, meta): meta has size, position, l of the document and l of the token, and the side in a pair of parts
    (0: both are one part), in 27, 27, 4, 3 and 2 bits."""
    if rare is None:
        rare = np.zeros(PLACES, np.int16)
    order = docs.sparkSession.sparkContext.broadcast((tokens, found, names, rare, chances(n, words, found)))  # 18 MB at most

    def run(batches):
        tokens, found, names, rare, likely = order.value
        seen, parts, held = set(), [], 0

        def flush():
            tok, name, meta = (np.concatenate(x) for x in zip(*parts))
            return pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(name), pa.array(meta)], ["token", "set_id", "meta"])

        for _, _, (s, total) in _each(batches, 0, n, rare):
            if not len(s):
                continue
            name = names.of(s)
            if name in seen:
                continue
            if len(seen) < 1 << 20:  # a set sent twice costs time only
                seen.add(name)
            tok, level, ell, df = prefix(s, tokens, found, t, likely=likely[total])
            meta = (((np.int64(len(s)) << 27) | np.arange(len(tok))) << 9) | (ell - 1 << 5 | level - 1 << 2)
            tok, meta = split_hot(tok, meta, df, name, hot)
            parts.append((tok, np.full(len(tok), name), meta))
            held += len(tok)
            if held > 200_000:
                yield flush()
                parts, held = [], 0
        if parts:
            yield flush()

    return docs.select("text").mapInArrow(tidied(run), "token long, set_id long, meta long")


def _runs(*cols: np.ndarray) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _whole_runs(batches, keys: int, columns: int):
    """Columns as arrays, cut so that rows that agree in the first `keys` columns stay together; the input is sorted by these."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        cut = 0
        for c in cols[:keys]:
            cut += int(np.searchsorted(c[cut:], c[-1], "left"))
        rest = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def _lists(batches):
    """From rows sorted by (token, set_id): (first set_id, token, set_id, meta, number of sets) of tokens that at least two sets have."""
    for token, name, meta in _whole_runs(batches, 1, 3):
        keep = _runs(token, name)
        token, name, meta = token[keep], name[keep], meta[keep]
        start = _runs(token)
        count = np.diff(np.r_[start, len(token)])
        many = np.repeat(count > 1, count)
        key = np.repeat(name[start], count)
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (key, token, name, meta, np.repeat(count, count))], ["key", "token", "set_id", "meta", "many"])


def _pairs(t: float):
    def run(batches):
        """Pairs of sets of different clumps that share prefix tokens, with the number of them, from rows sorted by (key, token, clump)."""
        acc: list[tuple] = []
        held = 0

        def reduced(parts):
            a, b, ell, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((b, a))
            a, b, ell, n = a[order], b[order], ell[order], n[order]
            at = _runs(a, b)
            return [(a[at], b[at], ell[at], np.add.reduceat(n, at))] if len(at) else []

        def out(parts):
            (a, b, ell, n) = parts[0]
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(ell.astype(np.int32)), pa.array(n.astype(np.int32))], ["a", "b", "ell", "n"])

        def some(x, y, name, meta):
            size, pos, ell, level, side = meta >> 36, (meta >> 9) & ((1 << 27) - 1), ((meta >> 5) & 7) + 1, ((meta >> 2) & 7) + 1, meta & 3
            need = np.minimum(ell[x], ell[y])
            sx, sy = size[x], size[y]
            overlap = np.ceil(t / (1 + t) * (sx + sy) - 1e-9)
            most = np.minimum(pos[x], pos[y]) + np.minimum(sx - pos[x], sy - pos[y])
            ok = ((side[x] != side[y]) | (side[x] == 0)) & (level[x] <= need) & (level[y] <= need) & (np.minimum(sx, sy) >= overlap) & (most >= overlap)
            x, y = x[ok], y[ok]
            swap = name[x] > name[y]
            return np.where(swap, name[y], name[x]), np.where(swap, name[x], name[y]), need[ok], np.ones(len(x), np.int64)

        for key, token, name, meta, clump in _whole_runs(batches, 2, 5):
            start = _runs(key, token)
            count = np.diff(np.r_[start, len(token)])
            own = np.r_[_runs(key, token, clump), len(token)]
            own = np.repeat(own[1:], np.diff(own))
            # row i is paired with the rows of its list after those of its clump
            after = np.repeat(start + count, count) - own
            upto = np.cumsum(after)
            i = 0
            while i < len(token):
                base = upto[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(upto, base + PAIRS_AT_ONCE, "right")))
                m = after[i:j]
                x = np.repeat(np.arange(i, j), m)
                y = own[x] + np.arange(len(x)) - np.repeat(np.cumsum(m) - m, m)
                part = some(x, y, name, meta)
                acc.append(part)
                held += len(part[0])
                if held >= PAIRS_AT_ONCE:
                    acc = reduced(acc)
                    held = len(acc[0][0]) if acc else 0
                    if held >= PAIRS_AT_ONCE // 2:
                        yield out(acc)
                        acc, held = [], 0
                i = j
        acc = reduced(acc) if acc else []
        if acc:
            yield out(acc)

    return run


def clumps(lists: DataFrame, long: int = LONG) -> DataFrame:
    """(id, clump) of sets that are together in at least two lists of `long` sets: a set goes with the first set of most of its
    lists, and that set with its own, two steps far. Every clump's name is the name of a set that is in some clump."""
    shared = lists.where(F.col("many") >= long).groupBy("set_id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    best = stored(shared.groupBy("set_id").agg(F.max(F.struct("n", "key")).alias("m")).select(F.col("set_id").alias("id"), F.col("m.key").alias("clump")), "clumps")
    step = small(best.select(F.col("id").alias("_k"), F.col("clump").alias("_c")), 16)
    far = best
    for _ in range(2):
        far = far.join(step, F.col("clump") == F.col("_k"), "left").select("id", F.coalesce("_c", "clump").alias("clump"))
    return stored(far, "clumps")


def candidates(docs: DataFrame, prof: DataFrame, names: Names, n: int, t: float, hot: int = HOT, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(a, b): set_ids of the candidate pairs of different clumps, a < b; (id, clump) of the sets in clumps, whose pairs all are
    candidates."""
    tokens, found = frequent(prof)
    words = prof.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rows = prefixes(docs, tokens, found, names, n, t, hot, rarity(prof), words).repartition("token").sortWithinPartitions("token", "set_id")
    lists = stored(rows.mapInArrow(tidied(_lists), "key long, token long, set_id long, meta long, many long"), "lists")
    clump = clumps(lists, long)
    # a set outside has a clump of its own name, which no other has
    known = small(clump.withColumnRenamed("id", "_c"), 16)
    apart = lists.join(known, F.col("set_id") == F.col("_c"), "left").select("key", "token", "set_id", "meta", F.coalesce("clump", "set_id").alias("clump"))
    pairs = apart.repartition("key").sortWithinPartitions("key", "token", "clump").mapInArrow(tidied(_pairs(t)), "a long, b long, ell int, n int")
    pairs = stored(pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.first("ell").alias("ell")).where("n >= ell").select("a", "b"), "candidates")
    forget(lists)
    return pairs, clump


def _shared(tokens: list[np.ndarray], mark: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many marked tokens each of many sets has; none is empty."""
    out = np.empty(len(many), np.int64)
    size = np.array([len(tokens[j]) for j in many])
    upto, i = np.cumsum(size), 0
    while i < len(many):
        base = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, base + GATHERED, "right")))
        hit = mark[np.concatenate([tokens[k] for k in many[i:j]])]
        out[i:j] = np.add.reduceat(hit, np.r_[0, upto[i : j - 1] - base], dtype=np.int64)
        i = j
    return out


def _overlaps(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray, na: int, nb: int, tokens: int) -> np.ndarray:
    """How many tokens each of na sets shares with each of nb; set a[i] has token ta[i], set b[i] token tb[i]."""
    ca, cb = np.bincount(ta, minlength=tokens), np.bincount(tb, minlength=tokens)
    often = ca * cb > na * nb / 64
    out = np.zeros((na, nb), np.float32)  # exact below 2^24
    place = np.cumsum(often) - 1
    ia, ib = np.flatnonzero(often[ta]), np.flatnonzero(often[tb])
    ia, ib = ia[np.argsort(place[ta[ia]], kind="stable")], ib[np.argsort(place[tb[ib]], kind="stable")]
    pa_, pb = place[ta[ia]], place[tb[ib]]
    for c in range(0, int(often.sum()), COLUMNS):
        x, y = np.zeros((na, COLUMNS), np.float32), np.zeros((nb, COLUMNS), np.float32)
        for m, own, i, p in ((x, a, ia, pa_), (y, b, ib, pb)):
            u, v = np.searchsorted(p, (c, c + COLUMNS))
            m[own[i[u:v]], p[u:v] - c] = 1
        out += x @ y.T
    # tokens of few sets: the pairs of their sets, one by one
    rare = ~often & (ca > 0) & (cb > 0)
    ia, ib = np.flatnonzero(rare[ta]), np.flatnonzero(rare[tb])
    ib = ib[np.argsort(tb[ib], kind="stable")]
    first = np.cumsum(cb * rare) - cb * rare
    m = cb[ta[ia]]
    upto, i, flat = np.cumsum(m), 0, out.reshape(-1)
    while i < len(ia):
        base = upto[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(upto, base + 2 * PAIRS_AT_ONCE, "right")))
        k = m[i:j]
        y = np.repeat(first[ta[ia[i:j]]], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        flat += np.bincount(np.repeat(a[ia[i:j]], k) * nb + b[ib[y]], minlength=na * nb).astype(np.float32)
        i = j
    return out


def _tree(linked: np.ndarray, same: bool):
    """(root, node) that connect what linked does: rows and, behind them, columns, or with `same` rows alone."""
    na, nb = linked.shape
    rows, cols = np.ones(na, bool), np.ones(nb, bool)
    if same:
        cols = rows
    out = []
    for r in np.flatnonzero(linked.any(1)).tolist():
        if not rows[r]:
            continue
        rows[r], front = False, np.array([r])
        while len(front):
            front = np.flatnonzero(linked[front].any(0) & cols)
            cols[front] = False
            out += [(r, x if same else na + x) for x in front.tolist()]
            if not same:
                front = np.flatnonzero(linked[:, front].any(1) & rows)
                rows[front] = False
                out += [(r, x) for x in front.tolist()]
    return out


FOUND = "a long, b long, shared long, total long, tree boolean, links long"


def _found(a, b=None, shared=None, total=None, tree=None, links=None) -> pa.Table:
    column = lambda x, kind: pa.nulls(len(a), kind) if x is None else pa.array(x, kind)
    return pa.table({"a": column(a, pa.int64()), "b": column(b, pa.int64()), "shared": column(shared, pa.int64()), "total": column(total, pa.int64()), "tree": column(tree, pa.bool_()), "links": column(links, pa.int64())})


def _clump(t: float, how: str, left: pa.Table) -> pa.Table:
    """All pairs between two parts of a clump, or within one part (side 3)."""
    names, at = np.unique(left.column("set_id").to_numpy(), return_index=True)
    sets = left.column("tokens").combine_chunks()
    side, weight = left.column("side").to_numpy()[at], left.column("m").to_numpy()[at]
    flat, offs = sets.values.to_numpy(), sets.offsets.to_numpy()
    size = (offs[1:] - offs[:-1])[at].astype(np.int64)
    own = np.repeat(np.arange(len(at)), size)
    local = np.unique(flat[np.repeat(offs[at] - np.cumsum(size) + size, size) + np.arange(len(own))], return_inverse=True)[1]
    same = bool((side == 3).all())
    x, y = (np.arange(len(at)),) * 2 if same else (np.flatnonzero(side == 1), np.flatnonzero(side == 2))
    place = np.zeros(len(at), np.int64)
    place[x] = np.arange(len(x))
    place[y] = np.arange(len(y))
    ofx, ofy = (slice(None),) * 2 if same else (side[own] == 1, side[own] == 2)
    shared = _overlaps(place[own[ofx]], local[ofx], place[own[ofy]], local[ofy], len(x), len(y), int(local.max()) + 1 if len(local) else 1)
    linked = np.zeros(shared.shape, bool)
    for i in range(0, len(x), 256):
        s = shared[i : i + 256].astype(np.float64)
        linked[i : i + 256] = (s > 0) & (s >= t * (size[x[i : i + 256], None] + size[y] - s) - 1e-9)
    if same:
        np.fill_diagonal(linked, False)
    if how == "pairs":
        i, j = np.nonzero(np.triu(linked) if same else linked)
        a, b, s = x[i], y[j], shared[i, j].astype(np.int64)
        return _found(names[np.minimum(a, b)], names[np.maximum(a, b)], s, size[a] + size[b] - s, np.zeros(len(a), bool))
    ends = np.r_[x, y]
    tree = np.array(_tree(linked, same), np.int64).reshape(-1, 2)
    out = [_found(names[ends[tree[:, 0]]], names[ends[tree[:, 1]]], tree=np.ones(len(tree), bool))]
    if how == "links":
        for u, links in ((x, [int(weight[y][row].sum()) for row in linked]), (y, [int(weight[x][row].sum()) for row in linked.T]))[: 1 if same else 2]:
            out.append(_found(names[u], links=links))
    return pa.concat_tables(out)


def _verify(t: float, how: str):
    connect = how == "connect"

    def run(key, left, right):
        """Jaccard of the pairs in right over the sets in left, of one bucket, `tree` telling those that connect what no pair
        before them did. connect: only such pairs are verified and returned. A block of a clump has all its pairs compared."""
        if key[1].as_py() >= 0:
            out = _clump(t, how, left)
            release()
            return out
        names, at = np.unique(left.column("set_id").to_numpy(), return_index=True)
        sets = left.column("tokens").combine_chunks()
        flat, offs = sets.values.to_numpy(), sets.offsets.to_numpy()
        local = np.unique(flat, return_inverse=True)[1]
        tokens = [local[offs[i] : offs[i + 1]] for i in at]
        size = np.array([len(x) for x in tokens])
        a, b = (np.searchsorted(names, right.column(c).to_numpy()) for c in ("a", "b"))
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        shared = np.zeros(len(a), np.int64)
        mark = np.zeros(int(local.max()) + 1 if len(local) else 1, bool)
        start = _runs(a) if len(a) else []
        forest, tree = Forest(len(names)), np.zeros(len(a), bool)
        for s, e in zip(start, [*start[1:], len(a)]):
            own = int(a[s])
            mark[tokens[own]] = True
            if not connect:
                shared[s:e] = _shared(tokens, mark, b[s:e])
            else:
                for i, j in enumerate(b[s:e].tolist(), s):
                    if forest.root(j) != forest.root(own):
                        shared[i] = k = np.count_nonzero(mark[tokens[j]])
                        if k >= t * (size[own] + size[j] - k) - 1e-9:
                            tree[i] = forest.join(own, j)
            mark[tokens[own]] = False
        union = size[a] + size[b] - shared
        ok = (shared > 0) & (shared >= t * union - 1e-9)
        if not connect:
            tree[ok] = [forest.join(i, j) for i, j in zip(a[ok].tolist(), b[ok].tolist())]
        release()
        return _found(names[a[ok]], names[b[ok]], shared[ok], union[ok], tree[ok])

    return run


def similar_sets(docs: DataFrame, prof: DataFrame, names: Names, n: int = NGRAM, t: float = THRESHOLD, how: str = "pairs", hot: int = HOT, block_sets: int = BLOCK_SETS, long: int = LONG) -> DataFrame:
    """(a, b, shared, total, tree, links), stored. how = "pairs": (a, b, shared, total) of all pairs of distinct sets with
    shared / total >= t. "links": the pairs of a clump have no rows; instead, set a has there `links` rows of docs that are
    similar to it and of another set, to be added up. "connect": rows with tree only. In the last two, rows with tree connect
    what all similar pairs do; those without `shared` only tell that there is a way from a to b."""
    pairs, clump = candidates(docs, prof, names, n, t, hot, long)
    label = stored(components(pairs), "labels")
    count = label.count()
    large = label.groupBy("label").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block_sets).select(F.col("label").alias("_l"), F.ceil(F.col("m") / float(block_sets)).cast("long").alias("parts"))
    large = stored(large, "large")  # at most count / block_sets rows
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id"), F.col("parts"))).otherwise(F.lit(0)).cast("long")
    label = stored(label.join(small(large, 16), F.col("label") == F.col("_l"), "left").select("id", "label", part.alias("part"), F.col("parts").isNotNull().alias("split")), "labels")
    buckets = max(spread(docs.sparkSession, count, 4000), pairs.count() // (1 << 20))
    ends = lambda e: small(label.select(F.col("id").alias(f"_{e}"), F.col("label").alias(f"label_{e}"), F.col("part").alias(f"part_{e}"), F.col("split").alias(f"split_{e}")), 40, count)
    block = F.xxhash64("label_a", F.least("part_a", "part_b"), F.greatest("part_a", "part_b"))
    of_pair = pairs.join(ends("a"), F.col("a") == F.col("_a"))
    if not large.isEmpty():
        of_pair = stored(of_pair.join(ends("b"), F.col("b") == F.col("_b")).select("a", "b", block.alias("block"), "split_a"), "blocks")
        wide = of_pair.where("split_a")
        need = label.where("NOT split").select("id", F.xxhash64("label", F.lit(0).cast("long"), F.lit(0).cast("long")).alias("block"))
        need = need.unionByName(wide.select(F.col("a").alias("id"), "block").unionByName(wide.select(F.col("b").alias("id"), "block")).distinct())
    else:
        zero = F.lit(0).cast("long")
        of_pair = of_pair.select("a", "b", F.xxhash64("label_a", zero, zero).alias("block"))
        need = label.select("id", F.xxhash64("label", zero, zero).alias("block"))
    bucket = F.pmod(F.col("block"), F.lit(buckets)).alias("bucket")
    # one document of each set that is in a pair or a clump
    ids = stored(label.select("id").unionByName(clump.select("id")).distinct(), "ids")
    count = ids.count()
    sized = stored(prof.where("set_id IS NOT NULL").select("set_id", "doc_id", "uid", "size").join(small(ids, 8, count), F.col("set_id") == F.col("id")).groupBy("set_id").agg(F.min_by("doc_id", "uid").alias("doc_id"), F.count(F.lit(1)).alias("m"), F.max("size").alias("size")), "sized")
    wanted = sized.select("doc_id").distinct()
    chosen = integer_ids(docs).select("doc_id", "text").join(small(wanted.withColumnRenamed("doc_id", "_w"), 16, count), F.col("doc_id").eqNullSafe(F.col("_w")), "left_semi")

    def run(batches):
        parts, held = [], 0

        def flush():
            offs = np.cumsum([0, *(len(s) for _, s in parts)])
            flat = np.concatenate([s for _, s in parts]).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in parts], pa.int64()), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat))], ["set_id", "tokens"])

        for _, _, s in _each(batches, 1, n):
            if len(s):
                parts.append((names.of(s), s))
                held += len(s)
                if held > 1 << 18:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()

    sets = chosen.mapInArrow(tidied(run), "set_id long, tokens array<long>")
    none, key = F.lit(-1).cast("long"), ("bucket", "lo", "hi")
    need = need.select("id", bucket, none.alias("lo"), none.alias("hi"), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("side")).distinct()
    # a clump's parts meet each other, and themselves, in a block each
    member = clump.join(small(sized.select("set_id", "m", "size"), 24, count), F.col("id") == F.col("set_id")).select("id", "clump", "m", "size")
    parts = member.groupBy("clump").agg(F.ceil(F.greatest(F.count(F.lit(1)) / float(block_sets), F.sum("size") / float(PART_TOKENS))).cast("long").alias("parts"))
    parts = stored(parts, "parts").withColumnRenamed("clump", "_c")
    placed = member.join(small(parts, 16), F.col("clump") == F.col("_c")).withColumn("p", F.pmod(F.xxhash64("id"), F.col("parts")))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("p") < F.col("q"), 1).when(F.col("p") > F.col("q"), 2).otherwise(3).cast("long")
    blocks = placed.select("id", F.col("clump").alias("bucket"), F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "m", side.alias("side"))
    need = stored(need.unionByName(blocks), "need")
    sets = sets.join(small(need, 56), F.col("set_id") == F.col("id")).select("set_id", "tokens", "m", "side", *key)
    of_pair = of_pair.select("a", "b", bucket, none.alias("lo"), none.alias("hi"))
    found = sets.groupBy(*key).cogroup(of_pair.groupBy(*key)).applyInArrow(_verify(t, how), FOUND)
    return stored(found, "similar")


def similar_documents(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, bits: int = 64, hot: int = HOT, block_sets: int = BLOCK_SETS, long: int = LONG) -> DataFrame:
    """(doc_id, class_id, n_links) for every row of docs: the least doc_id of its class, and how many other rows are similar to it.

    Two rows are similar if their n-gram sets have shared / total >= t, and in one class if similar rows lead from one to
    the other. Words are those of decontam. A null or empty text, or one without words, is similar to none, with its own
    doc_id as class_id; one of fewer than n words is a single gram; rows of equal text, also under one doc_id, are similar. A
    null doc_id counts in its class, which has a null class_id only if it has no other. doc_id must be an integer column.
    An empty table gives no rows. Other columns are ignored. Results don't depend on the order's counts or on partitions.
    """
    prof, names = profile(docs, n, bits)
    rows = prof.where("uid IS NOT NULL").select("doc_id", "set_id")
    near = similar_sets(docs, prof, names, n, t, "links", hot, block_sets, long)
    label = stored(components(near.where("tree").select("a", "b")), "groups")
    inside, near = near.where("links > 0").select("a", F.col("links").alias("m")), near.where("shared IS NOT NULL").select("a", "b")
    sets = rows.where("set_id IS NOT NULL").groupBy("set_id").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("least"))
    sets = stored(sets.join(small(label, 16), F.col("set_id") == F.col("id"), "left").select("set_id", "m", "least", F.coalesce("label", "set_id").alias("group")), "sets")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = small(sets.select(F.col("set_id").alias("_s"), "m"), 16)
    across = both.join(size, F.col("b") == F.col("_s")).select("a", "m").unionByName(inside).groupBy("a").agg(F.sum("m").alias("across"))
    named = sets.groupBy("group").agg(F.min("least").alias("class_id"))
    per = sets.join(across, F.col("set_id") == F.col("a"), "left").join(named, "group").select(F.col("set_id").alias("_s"), "class_id", (F.col("m") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"))
    per = small(stored(per, "classes"), 24)
    words = rows.where("set_id IS NOT NULL").join(per, F.col("set_id") == F.col("_s")).select("doc_id", "class_id", "n_links")
    return words.unionByName(rows.where("set_id IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def similar_pairs(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, bits: int = 64, hot: int = HOT, block_sets: int = BLOCK_SETS, long: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b, shared, total) of the similar pairs of distinct n-gram sets, and (doc_id, set_id) of every row,
    set_id null without words. All similar pairs of rows are those of one set and those of a pair's sets."""
    prof, names = profile(docs, n, bits)
    return similar_sets(docs, prof, names, n, t, "pairs", hot, block_sets, long).drop("tree", "links"), prof.where("uid IS NOT NULL").select("doc_id", "set_id")


def one_of_each_group(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD, bits: int = 64, hot: int = HOT, block_sets: int = BLOCK_SETS, long: int = LONG) -> DataFrame:
    """docs without the rows that are linked, directly or through others, to a row of lower (doc_id, text) order.

    The kept row of a group is the one of least doc_id (nulls last). Rows without words all stay. Repeated rows of one
    doc_id and text: one stays. Columns may have any names; doc_id must be an integer column. An empty table stays empty.
    """
    prof, names = profile(docs, n, bits)
    rows = prof.where("set_id IS NOT NULL").select("uid", "doc_id", "set_id")
    label = stored(components(similar_sets(docs, prof, names, n, t, "connect", hot, block_sets, long).select("a", "b")), "groups")
    grouped = rows.join(small(label, 16), F.col("set_id") == F.col("id"), "left").select("uid", "doc_id", "set_id", F.coalesce("label", "set_id").alias("group"))
    size = grouped.groupBy("group").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("uid"))).alias("m"))
    first = stored(size.where("k > 1").select("group", F.col("m.uid").alias("first")), "first")
    lost = grouped.join(small(first, 16), "group").where(F.col("uid") != F.col("first")).groupBy("doc_id", "set_id").agg(F.count(F.lit(1)).alias("lost"))
    return _without(docs, stored(lost, "lost"), names, n)


def _without(docs: DataFrame, lost: DataFrame, names: Names, n: int) -> DataFrame:
    """docs less, for each (doc_id, set_id, lost), that many of its rows."""
    cols = docs.columns
    d, e, s, k, away, whole, gone, row = (free_name(x, cols) for x in ("_id", "_same", "_set", "_k", "_away", "_whole", "_gone", "_row"))
    key = F.col("doc_id").cast("long")
    ids = stored(lost.groupBy("doc_id").agg(F.sum("lost").alias(away)).withColumnRenamed("doc_id", d), "lost-ids")
    count = ids.count()
    total = docs.select(key.alias(e)).join(small(ids.select(d), 16, count), F.col(e).eqNullSafe(F.col(d)), "left_semi").groupBy(e).agg(F.count(F.lit(1)).alias("_all"))
    some = stored(ids.join(total, F.col(d).eqNullSafe(F.col(e))).select(d, (F.col("_all") == F.col(away)).alias(whole)), "lost-docs")
    sure = docs.join(small(some.select(d), 16, count), key.eqNullSafe(F.col(d)), "left_anti")
    mixed = some.where(f"NOT {whole}").select(d)
    if mixed.isEmpty():
        return sure
    # Repeated doc_ids of which only some rows go: told apart by their sets.
    again = docs.join(small(mixed, 16), key.eqNullSafe(F.col(d)), "left_semi").select(F.struct(*cols).alias(row), key.alias(e), F.col("text").alias("text"))

    def run(batches):
        for batch in batches:
            found = []
            raw, offsets = string_buffers(batch.column(2))
            for a, b in doc_chunks(offsets):
                found += [names.of(x) if len(x) else None for x in gram_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], names=[row, e, "text", s])

    named = again.mapInArrow(tidied(run), T.StructType([*again.schema.fields, T.StructField(s, T.LongType())]))
    num = named.withColumn(k, F.row_number().over(W.partitionBy(e, s).orderBy(F.xxhash64("text"))))
    there = lost.select(F.col("doc_id").alias(d), F.col("set_id").alias("_there"), F.col("lost").alias(gone))
    kept = num.join(there, F.col(e).eqNullSafe(F.col(d)) & (F.col(s) == F.col("_there")), "left").where(f"coalesce({k} > {gone}, true)")
    return sure.unionByName(kept.select(*(F.col(row)[c].alias(c) for c in cols)))


ORACLE = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {NGRAM - 1}], ' ') AS g FROM w, unnest(range(1, greatest(2, len(w) - {NGRAM - 2}))) AS u(i) WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE shared >= {THRESHOLD} * (x.size + y.size - shared) - 1e-9),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.doc_id),
m AS (SELECT doc_id, min(r) AS class_id FROM c GROUP BY doc_id),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.doc_id, class_id, coalesce(n, 0) AS n_links FROM m LEFT JOIN l ON l.a = m.doc_id
"""
