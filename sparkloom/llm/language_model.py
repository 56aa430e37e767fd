"""Language-model scoring with a gated recurrent network, in numpy.

The vocabulary is the most frequent words by counts over all documents, as many as cover COVER of all words, within what
the model may hold; a class-factored softmax predicts a word as a class (of words of about equal total root of frequency,
which gives rare words small classes) and a member of it. Training is truncated backpropagation over windows of WINDOW
words, many documents side by side, with the state carried from window to window; a document of more than SEGMENT words is
trained on in pieces of that length, each from a fresh state, so that it can go side by side with itself. Training is
distributed: in each of ROUNDS rounds the tasks train copies of the model on one of as many disjoint parts of the documents,
parted by hash, and the copies are averaged by their numbers of words; every word of every document is trained on once.
Scoring goes once over all documents and every word of them, the state carried through from a document's first word to its last.

A word outside the vocabulary is predicted as such, and then spelled with the frequencies of the corpus's bytes.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import doc_chunks, integer_ids, stored, string_buffers, tidied, words_of

#: Share of all words that the vocabulary covers if it may hold so many, and how many it may hold (ids from 1; 0 is any other word).
COVER, VOCAB = 0.95, 8192
#: Classes of the softmax, units of the state, numbers that stand for a word, words of a window.
CLASSES, UNITS, EMBED, WINDOW = 64, 24, 24, 16
#: Disjoint parts of the documents, together all of them, each trained on in a round of its own.
ROUNDS = 4
LANES, TRAIN_LANES, RATE, SEED = 1024, 512, 0.6, 11
#: Words of a document that are trained on in one lane.
SEGMENT = 1024
#: Words that are laid out in lanes at once (one document's at least), in training and in scoring; states that are scored at once.
TRAIN_WORDS, SCORE_WORDS, SCORE_ROWS = 2 << 20, 3 << 20, 1 << 14
#: Words that a window counts as at least, so that a few words make a small step.
FEWEST = 4096
#: Copies that one task averages.
FAN_IN = 16


class Vocabulary:
    """Words by rank of frequency, in classes; the ids of a class follow each other."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, unknown: int, byte_counts: np.ndarray):
        """hashes and counts in falling order of the counts, unknown the number of all other words."""
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int32)
        freq = np.concatenate([[unknown], counts]).astype(np.float64) + 1
        share = np.cumsum(np.sqrt(freq)) / np.sqrt(freq).sum()
        cls = np.minimum((share * CLASSES).astype(np.int64), CLASSES - 1)
        cls = np.unique(cls, return_inverse=True)[1]  # without empty classes
        self.cls = cls.astype(np.int32)
        self.size = np.bincount(cls)
        self.first = np.cumsum(self.size) - self.size
        self.freq = freq
        p = (byte_counts + 1) / (byte_counts.sum() + 257)
        self.spell = np.log(p[:256])
        self.end = float(np.log(p[256]))

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ids[at], 0).astype(np.int32)


def _exp(x: np.ndarray, bound: float) -> np.ndarray | float:
    """Turns the rows of x into exponentials in place, of x less the largest of a row where they might be too large; returns what was taken off."""
    off: np.ndarray | float = 0.0
    if bound > 60:
        off = x.max(1)
        x -= off[:, None]
    np.exp(x, out=x)
    return off


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Model:
    """A gated recurrent unit and a class-factored softmax. Ids: 0 unknown, 1.. words; the input at a document's start is the last row."""

    NAMES = ("e", "w", "b", "u", "wc", "bc", "wm", "bm")

    def __init__(self, voc: Vocabulary, seed: int = SEED):
        g = np.random.Generator(np.random.PCG64(seed))
        n, k, h = len(voc.freq), len(voc.size), UNITS
        normal = lambda *s, by: (g.standard_normal(s) * by).astype(np.float32)
        self.e = normal(n + 1, EMBED, by=0.3)
        self.w = normal(EMBED, 3 * h, by=EMBED**-0.5)
        self.b = np.zeros(3 * h, np.float32)
        self.u = normal(h, 3 * h, by=h**-0.5)
        self.wc = normal(k, h, by=0.05)
        self.wm = normal(n, h, by=0.05)
        by_class = np.bincount(voc.cls, voc.freq)
        self.bc = np.log(by_class / by_class.sum()).astype(np.float32)
        self.bm = np.log(voc.freq / by_class[voc.cls]).astype(np.float32)
        self.voc = voc
        self.bounds()

    def bounds(self) -> None:
        """How large a class's, and a member's, logit can be, as no state is beyond 1."""
        self.most_c = float(np.max(np.abs(self.wc).sum(1) + np.abs(self.bc)))
        self.most_m = float(np.max(np.abs(self.wm).sum(1) + np.abs(self.bm)))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in self.NAMES])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k in self.NAMES:
            a = getattr(self, k)
            setattr(self, k, flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        self.bounds()
        return self

    def gates(self, name: str) -> np.ndarray:
        """The weights w or u, or their bias b, by gate: r, z and the candidate, each in one piece."""
        a = getattr(self, name)
        return np.ascontiguousarray(a.reshape(-1, 3, UNITS).transpose(1, 0, 2))

    def given(self, ids: np.ndarray) -> np.ndarray:
        """What words put into the gates and the candidate, by gate."""
        x = np.matmul(self.e[ids], self.gates("w"))
        x += self.gates("b")
        return x

    def step(self, x: np.ndarray, h: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new state, gates r and z, candidate, its recurrent part); x is what given() says, u the recurrent weights by gate."""
        hu = np.matmul(h, u)
        rz = _sigmoid(x[:2] + hu[:2])
        c = rz[0] * hu[2]
        c += x[2]
        np.tanh(c, out=c)
        new = h - c
        new *= rz[1]
        new += c
        return new, rz, c, hu[2]

    def output(self, h: np.ndarray, target: np.ndarray, grad: bool = False):
        """Log-likelihood of each target given its state; with grad also the gradient of the sum for h, and adds up self.d."""
        voc, n = self.voc, len(h)
        cls = voc.cls[target]
        order = np.argsort(cls.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
        h, target, cls = h[order], target[order], cls[order]
        edge = np.searchsorted(cls, np.arange(len(voc.size) + 1))
        k = np.arange(n)
        e = h @ self.wc.T
        e += self.bc
        ll = e[k, cls]
        ll -= _exp(e, self.most_c)
        total = e @ np.ones(e.shape[1], e.dtype)
        ll -= np.log(total)
        if grad:
            np.divide(e, -total[:, None], out=e)
            e[k, cls] += 1
            dh = e @ self.wc
            self.d["wc"] += e.T @ h
            self.d["bc"] += e.sum(0)
        for c in np.flatnonzero(np.diff(edge)):
            if voc.size[c] == 1:
                continue
            i, j = edge[c], edge[c + 1]
            a = voc.first[c]
            b = a + voc.size[c]
            hr, at = h[i:j], (k[: j - i], target[i:j] - a)
            e = hr @ self.wm[a:b].T
            e += self.bm[a:b]
            got = e[at]
            got -= _exp(e, self.most_m)
            total = e @ np.ones(b - a, e.dtype)
            got -= np.log(total)
            ll[i:j] += got
            if grad:
                np.divide(e, -total[:, None], out=e)
                e[at] += 1
                dh[i:j] += e @ self.wm[a:b]
                self.d["wm"][a:b] += e.T @ hr
                self.d["bm"][a:b] += e.sum(0)
        back = np.empty(n, np.int64)
        back[order] = k
        return (ll[back], dh[back]) if grad else ll[back]


class Trainer:
    """Adagrad over truncated backpropagation."""

    def __init__(self, model: Model, rate: float = RATE):
        self.m, self.rate = model, rate
        self.sum = {k: np.full_like(getattr(model, k), 0.1) for k in Model.NAMES}

    def window(self, given: np.ndarray, target: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        """One update from a window of shape (words, lanes); target is -1 where none counts, fresh where the state begins anew."""
        m, n = self.m, UNITS
        words, lanes = given.shape
        m.d = {k: np.zeros_like(getattr(m, k)) for k in Model.NAMES if k != "e"}
        at = given.ravel()
        e, w, u = m.e[at], m.gates("w"), m.gates("u")
        x = np.matmul(e, w)
        x += m.gates("b")
        x = x.reshape(3, words, lanes, n)
        live = (~fresh).astype(h.dtype)[:, :, None]
        resets = fresh.any(1)
        shape = (words, lanes, n)
        out, prev, c, hu, rz = np.empty(shape, h.dtype), np.empty(shape, h.dtype), np.empty(shape, h.dtype), np.empty(shape, h.dtype), np.empty((2, *shape), h.dtype)
        for t in range(words):
            if resets[t]:
                h = h * live[t]
            prev[t] = h
            h, rz[:, t], c[t], hu[t] = m.step(x[:, t], h, u)
            out[t] = h
        on = np.flatnonzero(target >= 0)
        if len(on) == target.size:
            ll, dout = m.output(out.reshape(-1, n), target.ravel(), True)
        else:
            ll, dh = m.output(out.reshape(-1, n)[on], target.ravel()[on], True)
            dout = np.zeros((target.size, n), out.dtype)
            dout[on] = dh
        dout = dout.reshape(shape)
        back = np.zeros_like(h)
        r, z = rz
        keep = 1 - z
        to_z = prev - c
        to_z *= z
        to_z *= keep
        to_c = c * c
        np.subtract(1, to_c, out=to_c)
        to_c *= keep
        to_r = 1 - r
        to_r *= r
        to_r *= hu
        g = np.empty((4, *shape), c.dtype)  # for r, z, the candidate and its recurrent part
        back_u = np.ascontiguousarray(u.transpose(0, 2, 1))
        for t in range(words - 1, -1, -1):
            back += dout[t]
            dc = np.multiply(back, to_c[t], out=g[2, t])
            np.multiply(dc, to_r[t], out=g[0, t])
            np.multiply(back, to_z[t], out=g[1, t])
            np.multiply(dc, r[t], out=g[3, t])
            back *= z[t]
            for k, j in enumerate((0, 1, 3)):
                back += g[j, t] @ back_u[k]
            if resets[t]:
                back *= live[t]
        g = g.reshape(4, -1, n)
        one, flat = np.ones(g.shape[1], g.dtype), prev.reshape(-1, n).T
        d_in = g[0] @ w[0].T
        for k, j in enumerate((0, 1, 3)):
            part = slice(k * n, (k + 1) * n)
            m.d["u"][:, part] = flat @ g[j]
            m.d["w"][:, part] = e.T @ g[k]
            m.d["b"][part] = one @ g[k]
            if k:
                d_in += g[k] @ w[k].T
        order = np.argsort(at.astype(np.uint16) if len(m.e) < 1 << 16 else at, kind="stable")
        rows = at[order]
        cut = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        touched = rows[cut]
        self.d_e = touched, np.add.reduceat(d_in[order], cut, 0)
        scale = 16 / max(FEWEST, len(ll))
        g = self.d_e[1] * scale
        self.sum["e"][touched] += g * g
        m.e[touched] += self.rate * g / np.sqrt(self.sum["e"][touched])
        for k, g in m.d.items():
            g = g * scale
            np.clip(g, -5, 5, out=g)
            s, root = self.sum[k], g * g
            s += root
            np.sqrt(s, out=root)
            g /= root
            g *= self.rate
            a = getattr(m, k)
            a += g
        m.bounds()
        return h, float(ll.sum())


def lanes_of(size: np.ndarray, lanes: int) -> list[np.ndarray]:
    """Documents dealt to lanes, longest first to the shortest lane; longer lanes first."""
    heap = [(0, k) for k in range(min(lanes, len(size)))]
    got: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-size, kind="stable").tolist():
        n, k = heapq.heappop(heap)
        got[k].append(d)
        heapq.heappush(heap, (n + int(size[d]), k))
    return sorted((np.array(sorted(x)) for x in got if x), key=lambda x: -int(size[x].sum()))


class Packed:
    """Documents in lanes, word after word: `before[t]` words come before time t, at which the first before[t + 1] - before[t]
    lanes have one. ids, doc (whose word it is) and fresh (whether it is a document's first) in that order; `given` are the
    words before, `start` at a document's first. It takes no more room than the words do, however unequal the lanes."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, lanes: int, start: int):
        size = np.diff(first)
        full = np.flatnonzero(size)
        dealt = [full[x] for x in lanes_of(size[full], lanes)]
        length = np.array([int(size[x].sum()) for x in dealt], np.int64)
        longest = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(longest), "left")
        self.before = np.concatenate([[0], np.cumsum(active)])
        n = int(self.before[-1])
        self.ids, self.doc, self.given, self.fresh = np.empty(n, np.int32), np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n, bool)
        for k, docs in enumerate(dealt):
            m = size[docs]
            upto = np.cumsum(m) - m
            at = np.arange(int(m.sum())) + np.repeat(first[docs] - upto, m)
            to = self.before[: len(at)] + k
            word = ids[at]
            self.ids[to] = word
            self.given[to[1:]] = word[:-1]
            self.given[to[upto]] = start
            self.fresh[to[upto]] = True
            self.doc[to] = np.repeat(docs, m)


def fit(model: Model, ids: np.ndarray, first: np.ndarray, trainer: Trainer | None = None) -> float:
    """Trains on documents side by side; returns the log-likelihood met on the way."""
    trainer = trainer or Trainer(model)
    start = len(model.voc.freq)
    size = np.diff(first)
    count = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), count)
    begin = first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
    packed = Packed(ids, np.append(begin, first[-1]), TRAIN_LANES, start)
    before, seen = packed.before, 0.0
    h = np.zeros((int(before[1]) if len(before) > 1 else 0, UNITS), model.u.dtype)
    for a in range(0, len(before) - 1, WINDOW):
        b = min(a + WINDOW, len(before) - 1)
        m = int(before[a + 1] - before[a])
        shape = (b - a, m)
        given, target, fresh = np.full(shape, start, np.int32), np.full(shape, -1, np.int32), np.zeros(shape, bool)
        for t in range(a, b):
            x = slice(before[t], before[t + 1])
            k = x.stop - x.start
            given[t - a, :k], target[t - a, :k], fresh[t - a, :k] = packed.given[x], packed.ids[x], packed.fresh[x]
        h, ll = trainer.window(given, target, fresh, h[:m])
        seen += ll
    return seen


def log_likelihoods(model: Model, ids: np.ndarray, first: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """Of every document, over all of its words."""
    out = np.zeros(len(first) - 1)
    packed = Packed(ids, first, lanes, len(model.voc.freq))
    before, fresh = packed.before, packed.fresh
    h, a = np.zeros((int(before[1]) if len(before) > 1 else 0, UNITS), np.float32), 0
    u, table = model.gates("u"), model.given(np.arange(len(model.e)))
    while a < len(before) - 1:
        b = min(max(a + 1, int(np.searchsorted(before, before[a] + SCORE_ROWS, "right")) - 1), len(before) - 1)
        x = slice(int(before[a]), int(before[b]))
        into = np.take(table, packed.given[x], 1)
        states = np.empty((into.shape[1], UNITS), np.float32)
        edges = (before[a : b + 1] - before[a]).tolist()
        new = np.flatnonzero(fresh[x])
        for i, j in zip(edges, edges[1:]):
            h = h[: j - i]
            if len(new) and new[0] < j:
                k = np.searchsorted(new, j)
                h = h.copy()
                h[new[:k] - i] = 0
                new = new[k:]
            h = states[i:j] = model.step(into[:, i:j], h, u)[0]
        ll = model.output(states, packed.ids[x])
        out += np.bincount(packed.doc[x], ll, len(out))
        a = b
    return out


# ---- over a table ----


def _encoded(voc: Vocabulary, raw: np.ndarray, offsets: np.ndarray, spell: bool = True):
    """(ids, first word of each document, spelling log-likelihood of each document's unknown words: None unless asked for)."""
    h, starts, ends, first = words_of(raw, offsets)
    ids = voc.of(h)
    if not spell:
        return ids, first, None
    cost = np.concatenate([[0], np.cumsum(voc.spell[raw])])
    unknown = np.where(ids == 0, cost[ends] - cost[starts] + voc.end, 0) if len(ids) else np.zeros(0)
    upto = np.concatenate([[0], np.cumsum(unknown)])
    return ids, first, upto[first[1:]] - upto[first[:-1]]


def vocabulary(docs: DataFrame) -> Vocabulary:
    """From counts of every word and byte of all documents."""

    def run(batches):
        held, parts, spelled = 0, [], np.zeros(257, np.int64)

        def flush():
            h, c = (np.concatenate(x) for x in zip(*parts))
            h, inv = np.unique(h, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.int32()), pa.array(h.view(np.int64)), pa.array(np.bincount(inv, c).astype(np.int64))], names=["byte", "word", "n"])

        for batch in batches:
            raw, offsets = string_buffers(batch.column(0))
            for a, b in doc_chunks(offsets):
                part = raw[offsets[a] : offsets[b]]
                h, starts, ends, _ = words_of(part, offsets[a : b + 1] - offsets[a])
                if not len(h):
                    continue
                inside = np.zeros(len(part) + 1, np.int8)
                inside[starts] += 1
                inside[ends] -= 1
                spelled[:256] += np.bincount(part[np.cumsum(inside[:-1]) > 0], minlength=256)
                spelled[256] += len(h)
                parts.append(np.unique(h, return_counts=True))
                held += len(parts[-1][0])
                if held > 1 << 21:
                    yield flush()
                    parts, held = [], 0
        if parts:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(257), pa.int32()), pa.nulls(257, pa.int64()), pa.array(spelled)], names=["byte", "word", "n"])

    counts = stored(docs.select("text").mapInArrow(tidied(run), "byte int, word long, n long").groupBy("byte", "word").agg(F.sum("n").alias("n")), "words")
    spelled = np.zeros(257, np.int64)
    for r in counts.where("byte IS NOT NULL").collect():  # 257 rows
        spelled[r.byte] = r.n
    top = counts.where("byte IS NULL").orderBy(F.desc("n"), "word").limit(VOCAB).toArrow()  # the vocabulary's size
    total = counts.where("byte IS NULL").agg(F.sum("n")).first()[0] or 0
    n = top.column("n").to_numpy()
    n = n[: int(np.searchsorted(np.cumsum(n), COVER * total)) + 1]
    return Vocabulary(top.column("word").to_numpy().view(np.uint64)[: len(n)], n, int(total - n.sum()), spelled)


def _averaged(df: DataFrame, parts: int) -> tuple[np.ndarray, int] | None:
    """The mean of the rows (part, n, weights), weighted by n; every task adds up FAN_IN rows at most, in as many steps as that takes."""

    def add(table):
        n = table.column("n").to_numpy()
        total = np.zeros(0)
        for w, k in zip(table.column("weights"), n):
            x = np.frombuffer(w.as_py(), np.float32) * float(k)
            total = x if not len(total) else total + x
        return pa.table({"part": [table.column("part")[0].as_py()], "n": [int(n.sum())], "weights": [(total / n.sum()).astype(np.float32).tobytes()]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())]))

    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        df = df.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part").applyInArrow(add, "part int, n long, weights binary")
    rows = sorted(df.collect(), key=lambda r: r.part)  # FAN_IN rows at most
    n = sum(r.n for r in rows)
    return (sum(np.frombuffer(r.weights, np.float32).astype(np.float64) * (r.n / n) for r in rows), n) if n else None


def trained(docs: DataFrame, voc: Vocabulary) -> Model:
    """ROUNDS of training copies on disjoint parts, together all documents, each followed by an average."""
    sc, model = docs.sparkSession.sparkContext, Model(voc)
    slot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        now = sc.broadcast((voc, model.flat()))  # 2 MB, by the size of the vocabulary

        def run(batches, now=now, k=k):
            voc, flat = now.value
            model, parts = Model(voc).load(flat), []
            trainer, n = Trainer(model, RATE / (1 + k) ** 0.5), 0

            def learn():
                ids, first = np.concatenate([p[0] for p in parts]), np.cumsum([0, *(s for p in parts for s in np.diff(p[1]))])
                fit(model, ids, first, trainer)
                parts.clear()
                return len(ids)

            for batch in batches:
                raw, offsets = string_buffers(batch.column(0))
                for a, b in doc_chunks(offsets):
                    parts.append(_encoded(voc, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], False)[:2])
                if sum(len(p[0]) for p in parts) > TRAIN_WORDS:
                    n += learn()
            if parts:
                n += learn()
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([model.flat().tobytes()], pa.binary())], names=["part", "n", "weights"])

        part = docs.where(slot == k).select("text")
        got = _averaged(part.mapInArrow(tidied(run), "part int, n long, weights binary"), part.rdd.getNumPartitions())
        if got:
            model.load(got[0])
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_unknown, log_likelihood and perplexity per word, for every row of docs.

    Words are lower-cased runs of letters, digits and non-ASCII characters. A null or empty text, or one without words,
    has 0 words, log-likelihood 0 and perplexity null. Repeated rows get equal scores (up to rounding of sums), a null
    doc_id stays null, other columns are ignored, and documents are never cut. An empty table gives no rows.
    """
    docs = integer_ids(docs).select("doc_id", "text")
    voc = vocabulary(docs)
    model = trained(docs, voc)
    now = docs.sparkSession.sparkContext.broadcast((voc, model.flat()))

    def run(batches):
        voc, flat = now.value
        model = Model(voc).load(flat)
        parts: list[tuple] = []

        def scored():
            ids, n, spelled = (np.concatenate([p[k] for p in parts]) for k in range(3))
            first = np.concatenate([[0], np.cumsum(n)])
            unknown = np.concatenate([[0], np.cumsum(ids == 0)])
            ll = log_likelihoods(model, ids, first) + spelled
            per = np.exp(np.minimum(-ll / np.maximum(n, 1), 700))
            names = pa.concat_arrays([p[3] for p in parts])
            parts.clear()
            return pa.RecordBatch.from_arrays([names, pa.array(n, pa.int64()), pa.array(unknown[first[1:]] - unknown[first[:-1]], pa.int64()), pa.array(ll), pa.array(per, mask=n == 0)], names=["doc_id", "n_words", "n_unknown", "log_likelihood", "perplexity"])

        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            for a, b in doc_chunks(offsets):
                ids, first, spelled = _encoded(voc, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                parts.append((ids, np.diff(first), spelled, batch.column(0).slice(a, b - a)))
                if sum(len(p[0]) for p in parts) >= SCORE_WORDS:
                    yield scored()
        if parts:
            yield scored()

    return docs.mapInArrow(tidied(run), "doc_id long, n_words long, n_unknown long, log_likelihood double, perplexity double")
