from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.exact_dedup import exact_duplicates


def expected(rows):
    groups, texts = defaultdict(list), sorted({(len(t.encode()), t.encode()) for _, t in rows if t is not None})
    rank = {t: k for k, (_, t) in enumerate(texts)}
    for d, t in rows:
        if t is not None:
            groups[t].append(d)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, d, 1))
        else:
            ids = [x for x in groups[t] if x is not None]
            out.append((d, rank[t.encode()], min(ids) if ids else None, len(groups[t])))
    return sorted(out, key=repr)


def check(make, rows, block):
    got = exact_duplicates(make(*rows), block).collect()
    assert sorted(((r.doc_id, r.identity, r.keep_id, r.n_copies) for r in got), key=repr) == expected(rows)
    kept = defaultdict(int)
    for r in got:
        if r.identity is not None:
            kept[r.identity] += not r.duplicate
    assert all(n == 1 for n in kept.values())


@pytest.mark.parametrize("block", [4, 4096])
def test_against_sorted_texts(make, block):
    base = "abcdefghijklmnop" * 5
    rows = [(i, base[: i % 23] + ("x" if i % 7 == 0 else "")) for i in range(60)] + [(100, None), (None, "abc"), (None, "abc"), (101, ""), (102, ""), (103, "é" * 9), (5, "abcde")]
    check(make, rows, block)


def test_odd_rows(odd, none):
    got = exact_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert [r.duplicate for r in got if r.identity is None] == [False, False]
    assert exact_duplicates(none).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=12), min_size=1, max_size=30))
def test_random_texts(make, texts):
    check(make, list(enumerate(texts)), 3)
