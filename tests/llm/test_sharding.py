import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm.sharding import SlotMap, first_map, rebalanced, shard_documents, slot_bytes


def shards_after(now, edits):
    now = list(now)
    for slot, a, b in edits:
        assert now[slot] == a
        now[slot] = b
    return now


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=64, max_size=64))
def test_rebalancing_never_makes_it_worse(load):
    now = first_map(64, 4)
    after = shards_after(now, rebalanced(now, dict(enumerate(load)), 4))
    most = lambda m: max(sum(x for x, s in zip(load, m) if s == k) for k in range(4))
    assert most(after) <= most(now)
    assert rebalanced(after, dict(enumerate(load)), 4) == []


def test_even_within_tolerance():
    load = {s: 10 + s % 7 for s in range(4096)}
    after = shards_after(first_map(), rebalanced(first_map(), load))
    sums = [0] * 64
    for s, k in enumerate(after):
        sums[k] += load[s]
    assert max(sums) <= 1.02 * sum(sums) / 64


def test_versions_and_rows(spark, odd, none, tmp_path):
    got = shard_documents(odd, path=f"file://{tmp_path}/map").collect()
    assert len(got) == odd.count()
    by = SlotMap(spark, f"file://{tmp_path}/map")
    assert by.versions()[0] == 1
    newest = {r.slot: r.shard for r in by.load(by.versions()[-1]).collect()}
    assert len(newest) == 4096
    for r in got:
        assert newest[r.slot] == r.shard and r.map_version == by.versions()[-1]
    again = shard_documents(odd, path=f"file://{tmp_path}/map").collect()
    assert {(r.doc_id, r.slot) for r in again} == {(r.doc_id, r.slot) for r in got}
    assert shard_documents(none).count() == 0


def test_slot_bytes(odd):
    rows = slot_bytes(odd).collect()
    assert sum(r.n_docs for r in rows) == odd.count()
    assert sum(r.n_bytes for r in rows) == sum(len((r.text or "").encode()) for r in odd.collect())


def brute_map(rows, slots, shards, tolerance):
    """Slot, bytes and shard of every row by the rules, over dictionaries."""
    at, load = [], [0] * slots
    for d, t in rows:
        key = str(d) if d is not None else t if t is not None else ""
        slot, n = int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % slots, len((t or "").encode())
        at.append((slot, n))
        load[slot] += n
    shard = [s * shards // slots for s in range(slots)]
    total = [sum(load[s] for s in range(slots) if shard[s] == k) for k in range(shards)]
    most, stuck = sum(load) / shards * (1 + tolerance), set()
    while True:
        full = [k for k in range(shards) if total[k] > most and k not in stuck]
        if not full:
            break
        src = min(full, key=lambda k: (-total[k], k))
        dst = min(range(shards), key=lambda k: (total[k], k))
        fits = [s for s in range(slots) if shard[s] == src and 0 < load[s] < total[src] - total[dst] and total[dst] + load[s] <= most]
        if not fits:
            stuck.add(src)
            continue
        slot = min(fits, key=lambda s: (-load[s], s))
        shard[slot] = dst
        total[src] -= load[slot]
        total[dst] += load[slot]
    return [(d, n, slot, shard[slot]) for (d, _), (slot, n) in zip(rows, at)]


def test_whole_query_against_brute_force(odd, make):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(100 + i, "x" * (i * 37 % 400)) for i in range(300)]
    for slots, shards in ((4096, 64), (64, 4)):
        got = [(r.doc_id, r.n_bytes, r.slot, r.shard) for r in shard_documents(make(*rows), slots, shards).collect()]
        assert sorted(got, key=repr) == sorted(brute_map(rows, slots, shards, 0.02), key=repr)
