import random
import re

import numpy as np
import pytest

from sparkloom.llm import decontam as D


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())


def brute(docs, bench, n):
    phrases = set()
    for t in bench:
        w = words(t)
        if w:
            phrases |= {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}
    out = []
    for d, t in docs:
        w, spans = words(t), []
        for i in range(len(w)):
            for m in {len(p) for p in phrases}:
                if tuple(w[i : i + m]) in phrases and i + m <= len(w):
                    spans.append((i, i + m))
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out += [(d, a, b) for a, b in merged]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_index_against_scanning(seed):
    g = np.random.default_rng(seed)
    s = np.concatenate([g.integers(1, 6, 700), [0]]).astype(np.int64)
    sa = D.suffix_array(s, 3)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    index = D.FMIndex(s, 3, 4)
    for m in (1, 2, 4):
        p = s[10 : 10 + m]
        lo, hi = index.search(p[None], np.array([m]))
        assert sorted(index.locate(np.arange(lo[0], hi[0]))) == [i for i in range(len(s) - m) if (s[i : i + m] == p).all()]


def test_spans_against_brute_force(make, spark):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("ab cd ef gh ij".split()) for _ in range(n))
    docs = [(i, text(r.randint(0, 60))) for i in range(60)] + [(None, text(30)), (99, None), (98, "")]
    bench = [text(12), text(7), "ab, CD!", None, "", "ij"]
    b = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    got = sorted(((x.doc_id, x.start_word, x.end_word) for x in D.contaminated_spans(make(*docs), b, 5).collect()), key=repr)
    assert got == brute(docs, bench, 5)


def test_several_parts_agree(make, spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"p{i}q{j}" for j in range(12))) for i in range(20)], "item_id long, text string")
    docs = make(*[(i, "start " + " ".join(f"p{i}q{j}" for j in range(2, 11)) + f" p{i + 1}q0 p{i + 1}q1 end") for i in range(19)])
    one = sorted(map(tuple, D.contaminated_spans(docs, bench).collect()))
    monkeypatch.setattr(D, "PART_BYTES", 300)
    assert sorted(map(tuple, D.contaminated_spans(docs, bench).collect())) == one and one


def test_removal_keeps_the_rest(make, spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    docs = make((1, "Before. One two, three four five six seven eight nine! After"), (2, "one two three"), (3, None), (4, "one two three four five six seven eight nine"))
    out = {r.doc_id: r for r in D.decontaminated(docs, bench).collect()}
    assert out[1].text == "Before. ! After" and out[1].n_chars == len("Before. ! After")
    assert out[2].text == "one two three" and out[3].text is None and out[4].text == ""
    assert D.decontaminated(docs, bench).columns == docs.columns
    assert D.decontaminated(odd, bench).count() == odd.count()
    assert D.contaminated_spans(none, bench).count() == 0
    assert D.contaminated_spans(docs, bench.limit(0)).count() == 0


def test_parts_change_nothing(make, spark, monkeypatch):
    line = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(i, " ".join(line[i : i + 10])) for i in range(0, 30, 3)], "item_id long, text string")
    text = "before " + " ".join(line[:30]) + " after " + " ".join(line[32:36])
    docs = make((1, text), (1, text), (None, text), (None, "other " + text), (2, "x " + text), (2, "nothing here"), (3, None))
    rows = lambda: (sorted(map(tuple, D.contaminated_spans(docs, bench).collect()), key=repr), sorted(map(tuple, D.decontaminated(docs, bench).collect()), key=repr))
    one = rows()
    monkeypatch.setattr(D, "PART_BYTES", 60)
    monkeypatch.setattr(D, "HELD_BYTES", 1)
    assert len(list(D._parts(bench))) > 3
    assert rows() == one and len(one[0]) == 5
