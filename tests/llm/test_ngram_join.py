import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from sparkloom.llm import ngram_join as J
from sparkloom.llm.components import components


def grams(text, n):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(x, y, t):
    return bool(x and y) and len(x & y) >= t * len(x | y) - 1e-9


def brute(rows, n, t):
    """(doc_id, class_id, n_links) of every row, sorted."""
    sets = [grams(x, n) for _, x in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if similar(sets[i], sets[j], t):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, least.get(root(i)), links[i]) for i, (d, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def corpus(seed, n=70):
    """Copies, near copies and passages that many share."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    base = [[r.choice(vocab) for _ in range(r.randint(1, 60))] for _ in range(12)]
    shared = [r.choice(vocab) for _ in range(15)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w + (shared if r.random() < 0.4 else []))))
    return rows


@pytest.mark.parametrize(("seed", "t", "n"), [(1, 0.6, 3), (2, 0.8, 2), (3, 0.4, 1)])
def test_every_row_has_its_class_and_links(make, seed, t, n):
    rows = corpus(seed)
    assert found(J.similar_documents(make(*rows), n, t)) == brute(rows, n, t)


@pytest.mark.parametrize(("bits", "hot", "block_sets"), [(3, 1 << 15, 2000), (64, 3, 2000), (64, 1 << 15, 4), (2, 4, 5)])
def test_shared_names_hot_tokens_and_large_clusters_change_nothing(make, bits, hot, block_sets):
    rows = corpus(5)
    docs = make(*rows)
    want = brute(rows, 3, 0.6)
    assert found(J.similar_documents(docs, bits=bits, hot=hot, block_sets=block_sets)) == want
    kept = sorted({c for _, c, _ in want})
    assert sorted(r.doc_id for r in J.one_of_each_group(docs, bits=bits, hot=hot, block_sets=block_sets).collect()) == kept


def test_no_link_between_different_texts_is_lost(make):
    rows = corpus(6)
    pairs, members = J.similar_pairs(make(*rows))
    sets = {}
    for r in members.collect():
        sets.setdefault(r.set_id, []).append(r.doc_id)
    text = dict(rows)
    assert all(len({grams(text[d], 3) for d in ds}) == 1 for ds in sets.values())
    got = {tuple(sorted((sets[r.a][0], sets[r.b][0]))): (r.shared, r.total) for r in pairs.collect()}
    first = [ds[0] for ds in sets.values()]
    want = {}
    for a, b in combinations(sorted(first), 2):
        x, y = grams(text[a], 3), grams(text[b], 3)
        if similar(x, y, 0.6):
            want[a, b] = len(x & y), len(x | y)
    assert got == want


def test_parts_of_a_hot_token_meet_once():
    tok, meta = np.array([5, 6], np.uint64), np.array([64, 128])
    seen = Counter()
    rows = {name: J.split_hot(tok, meta, np.array([100, 2]), name, 10) for name in range(40)}
    for a, b in combinations(rows, 2):
        for x, mx in zip(*rows[a]):
            for y, my in zip(*rows[b]):
                if x == y and (mx & 3 != my & 3 or mx & 3 == 0):
                    seen[a, b, int(mx) >> 6] += 1
    assert set(seen.values()) == {1} and len(seen) == 2 * 40 * 39 // 2


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(J.similar_documents(odd)) == brute(rows, J.NGRAM, J.THRESHOLD)
    assert J.similar_documents(none).count() == 0


def test_ids_of_other_kinds(make):
    docs = make((1, "a b c d"), (2, "a b c d"))
    small = docs.withColumn("doc_id", docs.doc_id.cast("int"))
    assert found(J.similar_documents(small)) == [(1, 1, 1), (2, 1, 1)]
    assert J.one_of_each_group(small).schema == small.schema
    with pytest.raises(TypeError, match="integer"):
        J.similar_documents(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_one_of_each_group_stays(make):
    rows = corpus(4)
    docs = make(*rows)
    got = J.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c, _ in brute(rows, 3, 0.6)})


def test_groups_of_odd_rows(odd, none):
    got = sorted(((r.doc_id, (r.text or "")[:20]) for r in J.one_of_each_group(odd).collect()), key=repr)
    assert got == sorted([(1, "the same text of a f"), (None, "a text without a num"), (None, ""), (3, ""), (4, ""), (5, "w0x0 w1x1 w2x2 w3x3 "), (7, "été ГОРОД 東京 ñ!"), (8, " \n\t "), (9, "!!! ???")], key=repr)
    assert J.one_of_each_group(none).count() == 0


def test_repeated_ids_with_different_texts_and_clashing_columns(make):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = make((1, a), (1, b), (2, a), (2, a))
    assert sorted((r.doc_id, r.text) for r in J.one_of_each_group(docs).collect()) == [(1, a), (1, b)]
    for name in ("lost", "_d", "_id", "_set", "_k", "_s", "_whole", "_lost", "_row", "_same", "_all", "_there", "set_id", "uid", "group", "id"):
        docs = docs.withColumnRenamed("label", name) if "label" in docs.columns else docs.withColumn(name, docs.size)
    got = J.one_of_each_group(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(1, a), (1, b)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)], "a long, b long")
    got = {r.id: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize(("hot", "block_sets", "long"), [(1 << 15, 2000, 2), (1 << 15, 4, 3), (3, 5, 2)])
def test_clumps_change_nothing(make, hot, block_sets, long):
    rows = corpus(8, 60)
    rows += [(100 + i, rows[i][1]) for i in range(10)]  # sets of several rows
    docs = make(*rows)
    want = brute(rows, 3, 0.6)
    kinds = {"hot": hot, "block_sets": block_sets, "long": long}
    assert found(J.similar_documents(docs, **kinds)) == want
    assert sorted(r.doc_id for r in J.one_of_each_group(docs, **kinds).collect()) == sorted({c for _, c, _ in want})
    pairs, members = J.similar_pairs(docs, **kinds)
    text, first = dict(rows), {}
    for r in members.collect():
        first[r.set_id] = min(r.doc_id, first.get(r.set_id, r.doc_id))
    got = sorted((*sorted((first[r.a], first[r.b])), r.shared, r.total) for r in pairs.collect())
    sets = [(d, grams(text[d], 3)) for d in sorted(first.values())]
    assert got == [(a, b, len(x & y), len(x | y)) for (a, x), (b, y) in combinations(sets, 2) if similar(x, y, 0.6)]


def test_many_near_copies_are_not_paired_list_by_list(make):
    r = random.Random(9)
    rows = []
    for i in range(90):
        w = [f"w{j}" for j in range(120)]
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    docs = make(*rows)
    assert sum(n for *_, n in brute(rows, 3, 0.6)) > 90 * 40
    prof, names = J.profile(docs)
    found = J.candidates(docs, prof, names, 3, 0.6)
    pairs = found[0] if isinstance(found, tuple) else found
    assert pairs.count() < 200


def test_overlaps_of_frequent_and_rare_tokens():
    r = np.random.default_rng(3)
    x, y = (r.random((n, 300)) < np.r_[np.full(100, 0.7), np.full(200, 0.02)] for n in (40, 33))
    got = J._overlaps(*np.nonzero(x), *np.nonzero(y), 40, 33, 300)
    assert np.array_equal(got, x.astype(int) @ y.astype(int).T)


def test_grams_shared_by_chance_come_last_though_not_counted(make):
    """Of grams of which each partition has too few to count them, those of rare words come first: hardly a list has two sets."""
    r = random.Random(10)
    rare = iter(range(10**6))
    docs = make(*((i, " ".join(r.choice("abcdefghij") if j % 12 else f"x{next(rare)}" for j in range(150))) for i in range(64))).repartition(32)
    prof, names = J.profile(docs)
    rows = J.prefixes(docs, *J.frequent(prof), names, 3, 0.6, **({"rare": J.rarity(prof), "words": 64 * 148} if hasattr(J, "rarity") else {}))
    tokens = Counter(x.token for x in rows.select("token").collect())
    assert sum(n for n in tokens.values() if n > 1) < 0.5 * sum(tokens.values())
