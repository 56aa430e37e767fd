from collections import Counter, defaultdict

from sparkloom.llm import mixing as M


def docs_of(make, n=60):
    return make(*[(i, " ".join(["t"] * (1 + i * 7 % 40)), ["hot", "hot", "hot", "b", None][i % 5]) for i in range(n)])


def test_schedule_follows_the_weights_early(spark):
    weights = {"a": 1, "b": 2, "c": 5, "gone": 0}
    rows = M.schedule(spark, weights, 4000).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(4000))
    seen = Counter()
    for k, r in enumerate(rows, 1):
        assert r.rank == seen[r.source]
        seen[r.source] += 1
        if k >= 50:
            assert all(abs(seen[s] - k * w / 8) < 6 for s, w in weights.items())


def test_blocks_are_equal_and_cover_the_streams(make):
    docs = docs_of(make)
    size = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    got = M.mix_sources(docs, block_tokens=25, slots=400).collect()
    per_slot = defaultdict(int)
    for r in got:
        assert source[r.doc_id] == r.source and 0 <= r.first_token and r.first_token + r.n_tokens <= size[r.doc_id]
        per_slot[r.slot, r.source, r.block] += r.n_tokens
    last = {s: -(-sum(n for d, n in size.items() if source[d] == s) // 25) - 1 for s in set(source.values())}
    for (_, s, b), n in per_slot.items():
        assert n == 25 or b == last[s]
    for s in last:
        one = [r for r in got if r.source == s and r.epoch == 0]
        if {r.block for r in one} == set(range(last[s] + 1)):
            whole = Counter()
            for r in one:
                whole[r.doc_id] += r.n_tokens
            assert whole == Counter({d: n for d, n in size.items() if source[d] == s})


def test_bucket_width_changes_nothing(make, monkeypatch):
    docs = docs_of(make)
    one = sorted(map(tuple, M.mix_sources(docs, block_tokens=25).collect()), key=repr)
    monkeypatch.setattr(M, "BUCKET_DOCS", 3)
    monkeypatch.setattr(M, "CHUNK_SLOTS", 7)
    assert sorted(map(tuple, M.mix_sources(docs, block_tokens=25).collect()), key=repr) == one


def test_odd_rows(odd, none):
    got = M.mix_sources(odd, block_tokens=8).collect()
    assert got and {r.source for r in got} == {"a", "b", "c", None}
    assert M.mix_sources(none).count() == 0
    assert M.mix_sources(odd.where("text IS NULL")).count() == 0


def test_whole_documents(odd, none, make):
    out = M.mixed_documents(odd)
    assert out.columns == odd.columns
    empty = [r for r in out.collect() if not r.text]
    assert len(empty) == 3
    docs = docs_of(make)
    rows = M.mixed_documents(docs, {"hot": 1, "b": 1}, 25).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.source] += len(r.text.split())
    assert None not in tokens and 0.6 < tokens["hot"] / tokens["b"] < 1.6
    assert M.mixed_documents(none).count() == 0
