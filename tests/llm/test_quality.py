import random

import numpy as np
import pyarrow as pa

from sparkloom.llm import quality as Q
from sparkloom.llm.common import string_buffers


def texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8)))
    out, good = [], []
    for i in range(n):
        w = [word() for _ in range(r.randint(30, 200))]
        bad = i % 2
        out.append(" ".join(x.upper() + "!!" if bad and r.random() < 0.5 else x for x in w))
        good.append(1 - bad)
    return out, np.array(good, float)


def test_held_out_accuracy():
    t, g = texts(300, 1)
    net = Q.train(t[:200], g[:200], epochs=6)
    p = Q.score(net, *string_buffers(pa.array(t[200:]), lower=False))
    assert ((p >= 0.5) == (g[200:] == 1)).mean() > 0.95


def test_gradients(monkeypatch):
    """One step of training goes down the loss."""
    t, g = texts(32, 2)
    raw = string_buffers(pa.array(t), lower=False)
    loss = lambda net: -np.mean(np.log(np.where(g == 1, q := np.clip(Q.score(net, *raw), 1e-9, 1 - 1e-9), 1 - q)))
    assert loss(Q.train(t, g, epochs=8)) < loss(Q.Net()) - 0.1


def test_chunks_cover_every_window():
    """Pooling over chunks is pooling over all windows of the whole document."""
    net = Q.Net()
    g = np.random.default_rng(0)
    for n in (0, 1, 5, 6, 255, 256, 257, 502, 503, 4000):
        b = g.integers(0, 256, n).astype(np.uint8)
        codes, first = Q.chunks_of(b, np.array([0, n]))
        top = net.pooled(codes)[0].max(0)
        padded = np.concatenate([b.astype(int), np.full(max(0, Q.WIDTH - n), 256)])
        windows = [net.embed[padded[i : i + Q.WIDTH]].ravel() for i in range(len(padded) - Q.WIDTH + 1)]
        brute = (np.array(windows) @ net.filters).max(0) + net.bias
        # the last chunk may also see padding
        assert (top >= brute - 1e-4).all()
        if n >= Q.CHUNK and (n - Q.WIDTH + 1) % (Q.CHUNK - Q.WIDTH + 1) == 0:
            assert np.allclose(top, brute, atol=1e-4)


def test_odd_rows(spark, odd, none, make):
    t, g = texts(60, 3)
    docs = odd.unionByName(make(*[(1000 + i, x) for i, x in enumerate(t)]))
    labels = spark.createDataFrame([(1000 + i, int(x), 0) for i, x in enumerate(g)] + [(1, None, None), (None, 1, 0), (1000, None, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.quality <= 1 for r in rows)
    assert np.ptp([r.quality for r in rows if r.doc_id == 2]) < 1e-5
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in rows)
    assert Q.classify(none, labels).count() == 0
    unfitted = Q.classify(odd, labels.limit(0)).collect()
    assert all(r.keep and r.quality is None for r in unfitted)


def test_the_sample_is_bounded(spark, make):
    t, g = texts(60, 3)
    labels = spark.createDataFrame([(i, int(x), 0) for i, x in enumerate(g)], "doc_id long, quality int, toxic int")
    assert len(Q.sample(make(*enumerate(t)), labels, 20)[0]) == 20


def one_by_one(net, text):
    """The probability of a text by the definitions, window by window in 64 bits."""
    p = {k: v.astype(np.float64) for k, v in net.state().items()}
    b = list((text or "").encode())
    step, width, chunk = Q.CHUNK - Q.WIDTH + 1, Q.WIDTH, Q.CHUNK
    n = max(1, -(-max(len(b) - width + 1, 1) // step))
    pooled = []
    for c in range(n):
        codes = (b[c * step : c * step + chunk] + [256] * chunk)[:chunk]
        y = [np.concatenate([p["embed"][x] for x in codes[i : i + width]]) @ p["filters"] for i in range(step)]
        pooled.append(np.maximum(np.max(y, 0) + p["bias"], 0))
    f = np.concatenate([np.max(pooled, 0), np.mean(pooled, 0)])
    h = np.maximum(f @ p["w1"] + p["b1"], 0)
    return 1 / (1 + np.exp(-(h @ p["w2"] + p["b2"][0])))


def test_whole_query_against_definitions(spark, odd, make):
    t, g = texts(60, 3)
    docs = odd.where("doc_id IS NULL OR doc_id NOT IN (5, 6)").unionByName(make(*[(1000 + i, x) for i, x in enumerate(t)], (2000, t[0] * 9)))
    labels = spark.createDataFrame([(1000 + i, int(x), 0) for i, x in enumerate(g)], "doc_id long, quality int, toxic int")
    net = Q.train(*Q.sample(docs, labels))
    want = sorted(((r.doc_id, one_by_one(net, r.text)) for r in docs.collect()), key=repr)
    got = sorted(((r.doc_id, r.quality, r.keep) for r in Q.classify(docs, labels).collect()), key=repr)
    key = lambda d: (d is None, d or 0)
    want.sort(key=lambda r: (key(r[0]), r[1]))
    got.sort(key=lambda r: (key(r[0]), r[1]))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert np.allclose([r[1] for r in got], [r[1] for r in want], atol=1e-4)
    assert all(r[2] == (r[1] >= 0.5) for r in got)


def test_gradients_against_differences(monkeypatch):
    """The first step of Adam is the sign of the gradient, so the gradient itself is taken from the moments."""
    t, g = texts(4, 5)
    t = [x[:300] for x in t]
    raw = string_buffers(pa.array(t), lower=False)

    def loss(net):
        p = Q.score(net, *raw)
        return -np.mean(np.where(g == 1, np.log(p), np.log(1 - p)))

    before, grads = Q.Net(), {}
    plain = np.zeros_like
    made = []
    monkeypatch.setattr(Q.np, "zeros_like", lambda x, *a, **k: made.append(plain(x, *a, **k)) or made[-1])
    Q.train(t, g, epochs=1)
    monkeypatch.undo()
    for k, m in zip(Q.Net.NAMES, made):
        grads[k] = m * 10
    for k in ("w1", "w2", "b1", "b2", "filters", "embed", "bias"):
        a = getattr(before, k)
        i = np.unravel_index(np.abs(grads[k]).argmax(), a.shape)
        old, got = a[i], []
        for e in (1e-3, -1e-3):
            a[i] = old + e
            got.append(loss(before))
        a[i] = old
        assert np.isclose((got[0] - got[1]) / 2e-3, grads[k][i], rtol=0.05, atol=1e-4), k


def test_the_sample_is_bounded_whatever_is_repeated(spark, make):
    t, g = texts(60, 3)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)] * 5, "doc_id long, quality int, toxic int")
    docs = make(*[(1, x) for x in t] * 2, *[(2, t[0])] * 50)
    got, good = Q.sample(docs, labels, 20)
    assert len(got) <= 20 and len(set(zip(got, good))) == len(got)
    size = sorted(len(x) for x in t)
    got, _ = Q.sample(docs, labels, 1000, size[0] + size[1])
    assert got and sum(map(len, got)) <= size[0] + size[1]
    assert Q.sample(docs, labels, 1000, 3)[0] == []
