import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import language_model as L
from sparkloom.llm.common import hash_words, string_buffers, words_of


def voc_of(texts):
    raw, offsets = string_buffers(pa.array(texts))
    h, _, _, first = words_of(raw, offsets)
    u, n = np.unique(h, return_counts=True)
    order = np.argsort(-n, kind="stable")
    return L.Vocabulary(u[order], n[order], 0, np.bincount(raw, minlength=257)), raw, offsets


def cyclic(n, seed=0):
    """Each word tells the next: what only a model with a state or an input can learn."""
    r = random.Random(seed)
    return [" ".join("abcdefghijkl"[(s + i) % 12] * 2 for i in range(r.randint(5, 90))) for s in (r.randrange(12) for _ in range(n))]


def one_by_one(model, ids, first):
    """Log-likelihoods by the definitions, word by word in 64 bits."""
    p = {k: getattr(model, k).astype(np.float64) for k in L.Model.NAMES}
    voc, n, out = model.voc, L.UNITS, []
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for a, b in zip(first, first[1:]):
        h, ll, prev = np.zeros(n), 0.0, len(voc.freq)
        for t in ids[a:b]:
            x, hu = p["e"][prev] @ p["w"] + p["b"], h @ p["u"]
            r, z = sigmoid(x[:n] + hu[:n]), sigmoid(x[n : 2 * n] + hu[n : 2 * n])
            c = np.tanh(x[2 * n :] + r * hu[2 * n :])
            h = c + z * (h - c)
            k = voc.cls[t]
            members = np.flatnonzero(voc.cls == k)
            logits, inner = p["wc"] @ h + p["bc"], p["wm"][members] @ h + p["bm"][members]
            ll += logits[k] - np.log(np.exp(logits).sum()) + inner[list(members).index(t)] - np.log(np.exp(inner).sum())
            prev = t
        out.append(ll)
    return out


def test_lanes_and_windows_change_nothing():
    texts = cyclic(40) + ["", "solo"]
    voc, raw, offsets = voc_of(texts)
    model = L.Model(voc)
    g = np.random.default_rng(0)
    model.load(model.flat() + 0.2 * g.standard_normal(len(model.flat())).astype(np.float32))
    ids, first, _ = L._encoded(voc, raw, offsets)
    brute = one_by_one(model, ids, first)
    for lanes in (1, 3, 64):
        assert np.allclose(L.log_likelihoods(model, ids, first, lanes), brute, atol=1e-2, rtol=1e-4)


def test_probabilities_sum_to_one():
    voc, *_ = voc_of(cyclic(30) + ["rare word one two three"])
    model = L.Model(voc)
    h = np.random.default_rng(1).standard_normal((1, L.UNITS)).astype(np.float32)
    n = len(voc.freq)
    ll = model.output(np.repeat(h, n, 0), np.arange(n))
    assert np.isclose(np.exp(ll).sum(), 1, atol=1e-4)


def test_learning_beats_frequencies():
    texts = cyclic(400)
    voc, raw, offsets = voc_of(texts)
    ids, first, _ = L._encoded(voc, raw, offsets)
    cut = first[300]
    model = L.Model(voc)
    before = L.log_likelihoods(model, ids[cut:], first[300:] - cut).sum()
    trainer = L.Trainer(model)
    for _ in range(6):
        L.fit(model, ids[:cut], first[:301], trainer)
    after = L.log_likelihoods(model, ids[cut:], first[300:] - cut).sum()
    assert after > 0.5 * before


def test_gradient_of_a_window():
    voc, raw, offsets = voc_of(cyclic(20))
    ids, _, _ = L._encoded(voc, raw, offsets)
    model = L.Model(voc)
    for k in L.Model.NAMES:
        setattr(model, k, getattr(model, k).astype(np.float64))
    trainer = L.Trainer(model, 0.0)
    given, target, fresh = ids[:30].reshape(6, 5), ids[1:31].reshape(6, 5).copy(), np.zeros((6, 5), bool)
    fresh[3, 2], target[4:, 1] = True, -1
    h = np.random.default_rng(0).standard_normal((5, L.UNITS)) * 0.3
    run = lambda: trainer.window(given, target, fresh, h)[1]
    run()
    d = {k: v.copy() for k, v in model.d.items()} | {"e": np.zeros_like(model.e)}
    touched, g = trainer.d_e
    d["e"][touched] = g
    for k in L.Model.NAMES:
        a = getattr(model, k)
        i = np.unravel_index(np.abs(d[k]).argmax(), a.shape)
        v = a[i]
        got = []
        for e in (1e-5, -1e-5):
            getattr(model, k)[i] = v + e
            got.append(run())
        getattr(model, k)[i] = v
        assert np.isclose((got[0] - got[1]) / 2e-5, d[k][i], rtol=1e-4), k


def test_packed_lanes_hold_every_word_once():
    r = random.Random(4)
    size = np.array([r.choice([0, 1, 3, 40]) for _ in range(50)] + [700])
    first = np.concatenate([[0], np.cumsum(size)])
    ids = np.arange(first[-1])
    p = L.Packed(ids, first, 8, -1)
    assert sorted(p.ids) == list(ids) and p.before[-1] == len(ids)
    assert all(first[d] <= i < first[d + 1] for i, d in zip(p.ids, p.doc))
    assert all((g == -1 and f) if i == first[d] else (g == i - 1 and not f) for i, g, d, f in zip(p.ids, p.given, p.doc, p.fresh))
    lanes = {}
    for t in range(len(p.before) - 1):
        for k, at in enumerate(range(p.before[t], p.before[t + 1])):
            lanes.setdefault(k, []).append(at)
    for x in lanes.values():  # a document's words follow each other in its lane
        assert all(p.fresh[b] or p.ids[b] == p.ids[a] + 1 for a, b in zip(x, x[1:]))


def test_long_documents_are_trained_on_whole(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 10)
    texts = cyclic(20)
    voc, raw, offsets = voc_of(texts)
    ids, first, _ = L._encoded(voc, raw, offsets)
    model, seen = L.Model(voc), []
    plain = L.Trainer.window
    monkeypatch.setattr(L.Trainer, "window", lambda self, given, target, fresh, h: seen.append(target[target >= 0]) or plain(self, given, target, fresh, h))
    L.fit(model, ids, first)
    assert sorted(np.concatenate(seen)) == sorted(ids)


def test_whole_query_against_definitions(make):
    """Vocabulary, spelling and score of every row, by dictionaries and one word at a time."""
    texts = cyclic(60) + ["aa bb zz qux", "Zz QUX! zz", "", None, "été 東京 aa", "solo"]
    docs = make(*enumerate(texts))
    rows = {r.doc_id: r for r in L.score_documents(docs).collect()}
    words = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    counts = Counter(w for x in words for w in x)
    voc = L.vocabulary(docs)
    hashes = dict(zip(counts, hash_words(list(counts))))
    want = dict(zip((hashes[w] for w in counts), counts.values()))
    got = {h: voc.freq[i] - 1 for h, i in zip(voc.hashes, voc.ids)}
    assert all(want[h] == n for h, n in got.items())
    total = sum(counts.values())
    kept = sorted(got.values(), reverse=True)
    assert sum(kept) >= L.COVER * total > sum(kept[:-1]) and kept == sorted(counts.values(), reverse=True)[: len(kept)]
    spelled = Counter(b for x in words for w in x for b in w.encode())
    cost = lambda w: sum(np.log((spelled[b] + 1) / (spelled.total() + total + 257)) for b in w.encode()) + np.log((total + 1) / (spelled.total() + total + 257))
    model = L.trained(docs, voc)
    named = {h: i for h, i in zip(voc.hashes, voc.ids)}
    for d, x in enumerate(words):
        ids = np.array([named.get(hashes[w], 0) for w in x], np.int64)
        ll = (one_by_one(model, ids, [0, len(ids)])[0] if len(ids) else 0) + sum(cost(w) for w, i in zip(x, ids) if i == 0)
        assert rows[d].n_words == len(x) and rows[d].n_unknown == int((ids == 0).sum())
        assert np.isclose(rows[d].log_likelihood, ll, rtol=1e-4, atol=1e-3)
        assert rows[d].perplexity is None if not x else np.isclose(rows[d].perplexity, np.exp(-ll / len(x)), rtol=1e-3)


def test_table(spark, odd, none, make):
    docs = odd.unionByName(make(*[(100 + i, t) for i, t in enumerate(cyclic(300))]))
    rows = L.score_documents(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].n_words == 0 and by[3][0].log_likelihood == 0 and by[3][0].perplexity is None
    assert by[5][0].n_words == 40_000 and by[5][0].log_likelihood < 0
    assert abs(by[2][0].log_likelihood - by[2][1].log_likelihood) < 1e-2
    assert all(r.perplexity > 0 for r in rows if r.n_words)
    assert L.score_documents(none).count() == 0


def test_counts_cover_all_documents(make):
    docs = make(*[(i, f"common common word{i}") for i in range(50)])
    voc = L.vocabulary(docs)
    assert voc.freq[1:].sum() - len(voc.freq) + 1 + voc.freq[0] - 1 == pytest.approx(150)


def test_averages_are_weighted(spark):
    rows = [(i, i + 1, np.full(3, i, np.float32).tobytes()) for i in range(100)]
    df = spark.createDataFrame(rows, "part int, n long, weights binary")
    got, n = L._averaged(df, 100)
    assert n == 5050 and np.allclose(got, sum(i * (i + 1) for i in range(100)) / 5050, rtol=1e-5)


def test_every_document_is_trained_on(make, monkeypatch):
    docs = make(*[(i, f"a{i} b{i} c{i}") for i in range(40)])
    seen, plain = [], L._averaged
    monkeypatch.setattr(L, "_averaged", lambda df, parts: seen.append(plain(df, parts)) or seen[-1])
    L.trained(docs, L.vocabulary(docs))
    assert sum(x[1] for x in seen if x) == 120


def test_a_table_of_one_row_is_trained_on(make):
    docs = make((1, "one two one two"))
    voc = L.vocabulary(docs)
    assert not np.array_equal(L.trained(docs, voc).flat(), L.Model(voc).flat())
