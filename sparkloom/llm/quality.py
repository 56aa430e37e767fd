"""Quality classifier: a convolutional network over bytes, in numpy.

A text is cut into chunks of CHUNK bytes that overlap by WIDTH - 1, so that every window of WIDTH bytes of the whole
document lies in one. In each chunk the learned filters slide over the embedded bytes and are max-pooled; a document's
features are the maximum and the mean of its chunks' pooled values, and a small dense layer combines them into one
probability. Training is by backpropagation (Adam) on a bounded sample of labelled rows, whole texts, on the driver;
scoring is one pass over all texts in the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import doc_chunks, small, string_buffers, tidied

EMBED, WIDTH, FILTERS, HIDDEN = 4, 6, 32, 16
CHUNK = 256
#: Labelled rows that are fitted at most, those of least hash, and bytes of their texts; the bounds don't depend on the corpus.
TRAIN_DOCS, TRAIN_BYTES = 3000, 64 << 20
EPOCHS, BATCH, RATE, SEED = 12, 32, 3e-3, 7
THRESHOLD = 0.5
#: Bytes that pass through the network at once.
AT_ONCE = 1 << 17


class Net:
    """Parameters of the network and its passes; every array is float32."""

    NAMES = ("embed", "filters", "bias", "w1", "b1", "w2", "b2")

    def __init__(self, seed: int = SEED):
        g = np.random.Generator(np.random.PCG64(seed))
        normal = lambda *s, by: (g.standard_normal(s) * by).astype(np.float32)
        self.embed = normal(257, EMBED, by=0.5)  # 256 stands beyond a document's ends
        self.filters = normal(WIDTH * EMBED, FILTERS, by=(WIDTH * EMBED) ** -0.5)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = normal(2 * FILTERS, HIDDEN, by=(2 * FILTERS) ** -0.5)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = normal(HIDDEN, by=HIDDEN**-0.5)
        self.b2 = np.zeros(1, np.float32)

    def state(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.NAMES}

    @classmethod
    def of(cls, state: dict[str, np.ndarray]) -> Net:
        net = cls.__new__(cls)
        net.__dict__.update(state)
        return net

    def pooled(self, codes: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maxima of each filter over each chunk, before the rectifier: (chunks, FILTERS); and where they stand.

        codes: the bytes of whole chunks one after the other, CHUNK - WIDTH + 1 apart, as a matrix (chunks, CHUNK).
        """
        n, step = len(codes), CHUNK - WIDTH + 1
        out = np.empty((n, FILTERS), np.float32)
        at = np.empty((n, FILTERS), np.int32) if where else None
        per = max(1, AT_ONCE // CHUNK)
        for a in range(0, n, per):
            e = self.embed[codes[a : a + per]].reshape(-1, CHUNK * EMBED)
            windows = np.lib.stride_tricks.as_strided(e, (len(e), step, WIDTH * EMBED), (e.strides[0], EMBED * e.itemsize, e.itemsize))
            y = (windows.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(e), step, FILTERS)
            out[a : a + per] = y.max(1)
            if at is not None:
                at[a : a + per] = y.argmax(1)
        return out + self.bias, at

    def head(self, pooled: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """(probability, hidden values, features, chunk of each maximum): first are the documents' first chunks, none is empty."""
        r = np.maximum(pooled, 0)
        top = np.maximum.reduceat(r, first, 0)
        mean = np.add.reduceat(r, first, 0) / np.diff(np.append(first, len(r)))[:, None].astype(np.float32)
        f = np.concatenate([top, mean], 1)
        h = np.maximum(f @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-(h @ self.w2 + self.b2[0]).astype(np.float64))), h, f, r


def chunks_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk matrix of bytes with 256 as padding, number of each document's first chunk); an empty document has one chunk of padding."""
    size, step = np.diff(offsets), CHUNK - WIDTH + 1
    count = np.maximum(1, -(-np.maximum(size - WIDTH + 1, 1) // step))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(size)), count)
    begin = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * step
    at = begin[:, None] + np.arange(CHUNK)
    beyond = at >= offsets[1:][doc][:, None]
    if not len(raw):
        return np.full(at.shape, 256, np.int16), first
    codes = raw[np.minimum(at, len(raw) - 1)].astype(np.int16)
    codes[beyond] = 256
    return codes, first


def train(texts: list[str], good: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Fits a network by mini-batches of documents; gradients reach the filters through the places of the maxima."""
    net, g = Net(seed), np.random.Generator(np.random.PCG64(seed + 1))
    codes, first = chunks_of(*string_buffers(pa.array(texts, pa.string()), lower=False))
    last = np.append(first[1:], len(codes))
    share = good.mean() if len(good) else 0.5
    weight = np.where(good == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3)).astype(np.float32)  # both classes count alike
    m = {k: np.zeros_like(v) for k, v in net.state().items()}
    v = {k: np.zeros_like(x) for k, x in net.state().items()}
    t = 0
    for epoch in range(epochs):
        order = g.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            docs = order[a : a + BATCH]
            rows = np.concatenate([np.arange(first[d], last[d]) for d in docs])
            count = last[docs] - first[docs]
            begin = np.cumsum(count) - count
            own = codes[rows]
            z, at = net.pooled(own, where=True)
            p, h, f, r = net.head(z, begin)
            d = ((p - good[docs]) * weight[docs] / len(docs)).astype(np.float32)
            grad = {"w2": h.T @ d, "b2": np.array([d.sum()], np.float32)}
            dh = d[:, None] * net.w2 * (h > 0)
            grad |= {"w1": f.T @ dh, "b1": dh.sum(0)}
            df = dh @ net.w1.T
            doc = np.repeat(np.arange(len(docs)), count)
            top = f[:, :FILTERS][doc]
            dz = (df[:, FILTERS:] / count[:, None])[doc].astype(np.float32)
            is_top = r == top
            dz += np.where(is_top, df[:, :FILTERS][doc] / np.maximum(1, np.add.reduceat(is_top, begin, 0, dtype=np.int64)[doc]), 0).astype(np.float32)
            dz *= z > 0
            grad["bias"] = dz.sum(0)
            seen = own[np.arange(len(own))[:, None, None], at[:, :, None] + np.arange(WIDTH)].astype(np.int64)  # (chunks, FILTERS, WIDTH)
            e = net.embed[seen].reshape(len(own), FILTERS, WIDTH * EMBED)
            grad["filters"] = np.einsum("cf,cfk->kf", dz, e, optimize=True)
            de = dz[:, :, None] * net.filters.T[None]
            flat = de.reshape(-1, EMBED)
            grad["embed"] = np.stack([np.bincount(seen.ravel(), flat[:, k], 257) for k in range(EMBED)], 1).astype(np.float32)
            t += 1
            rate = RATE * (1 - epoch / epochs) ** 0.5
            for k, x in net.state().items():
                m[k] += 0.1 * (grad[k] - m[k])
                v[k] += 0.001 * (grad[k] ** 2 - v[k])
                x -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def score(net: Net, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of every document, from all of its bytes."""
    out = np.empty(len(offsets) - 1)
    for a, b in doc_chunks(offsets, 1 << 20):
        codes, first = chunks_of(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        out[a:b] = net.head(net.pooled(codes)[0], first)[0]
    return out


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> tuple[list[str], np.ndarray]:
    """Labelled texts and whether each is good: of quality 1 and not toxic. A null label leaves the row out.

    At most `most` texts, and as many of them, in the order of the hash, as have most_bytes together; a text longer than
    that is passed over. Rows of one doc_id and text count once, different texts of one doc_id each. Only hashes and sizes
    are gathered before the bounds are applied.
    """
    fit = labels.select(F.col("doc_id").alias("_d"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int").alias("good"))
    fit = fit.where("_d IS NOT NULL AND good IS NOT NULL").groupBy("_d").agg(F.min("good").alias("good"))
    fit = fit.orderBy(F.xxhash64("_d"), "_d").limit(most)
    mark = F.xxhash64("text").alias("_h")
    have = docs.where("text IS NOT NULL").join(small(fit, 16, most), F.col("doc_id") == F.col("_d"))
    sizes = have.groupBy("_d", mark).agg(F.min(F.octet_length("text")).alias("n")).orderBy(F.xxhash64("_d"), "_d", "_h").limit(most).collect()  # `most` short rows
    chosen, room = [], most_bytes
    for r in sizes:
        if r.n <= room:
            chosen.append((r["_d"], r["_h"]))
            room -= r.n
    if not chosen:
        return [], np.zeros(0)
    keys = docs.sparkSession.createDataFrame(chosen, T.StructType([T.StructField("_e", fit.schema["_d"].dataType), T.StructField("_g", T.LongType())]))
    found = have.select("_d", "good", "text", mark).join(small(keys, 32, most), (F.col("_d") == F.col("_e")) & (F.col("_h") == F.col("_g")))
    rows = found.groupBy("_d", "_h").agg(F.min("text").alias("text"), F.min("good").alias("good")).collect()  # within both bounds
    rows.sort(key=lambda r: (r["_d"], r.text))
    return [r.text for r in rows], np.array([r.good for r in rows], np.float64)


def _scored(docs: DataFrame, net: Net, columns: list[str], keep: float | None) -> DataFrame:
    """columns of docs with `quality`, or if keep is given, only the rows of at least that probability."""
    state = docs.sparkSession.sparkContext.broadcast(net.state())  # a few KB
    k = columns.index("text")

    def run(batches):
        net = Net.of(state.value)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(k), lower=False)
            p = score(net, raw, offsets)
            if keep is not None:
                yield batch.filter(pc.greater_equal(pa.array(p), keep))
            else:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns)) if i != k), pa.array(p)], names=[*(c for c in columns if c != "text"), "quality"])

    chosen = docs.select(*columns)
    schema = chosen.schema if keep is not None else T.StructType([*(f for f in chosen.schema if f.name != "text"), T.StructField("quality", T.DoubleType())])
    return chosen.mapInArrow(tidied(run), schema)


def classify(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, quality (the probability of a good document) and keep, for every row of docs.

    A null or empty text is one chunk of padding: it is scored like any other. Repeated rows get equal scores (up to
    the rounding of 32-bit sums), a null doc_id is kept as it is and never fitted, other columns are ignored. Without any labelled text the untrained
    network would decide, so every row gets quality null and is kept. An empty table gives no rows.
    """
    texts, good = sample(docs, labels, train_docs)
    if not texts:
        return docs.select("doc_id", F.lit(None).cast("double").alias("quality"), F.lit(True).alias("keep"))
    return _scored(docs, train(texts, good), ["doc_id", "text"], None).select("doc_id", "quality", (F.col("quality") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that classify() keeps."""
    texts, good = sample(docs, labels, train_docs)
    return _scored(docs, train(texts, good), docs.columns, threshold) if texts else docs
