import hashlib
import math
import random
import re
from collections import Counter

import test_decontam
import test_ngram_join
import test_quality

import corpus_pipeline as P
from sparkloom.llm import decontam, mixing, ngram_join, quality, token_coder


def test_stages_take_effect(spark, tmp_path, make):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8)))
    good = [" ".join(word() for _ in range(60)) for _ in range(80)]
    leak = " ".join(word() for _ in range(20))
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(good)]
    rows += [(100 + i, t.upper().replace(" ", "!! "), "s0") for i, t in enumerate(good[:60])]
    rows += [(200, good[5], "s1"), (201, good[6] + " extra", "s1"), (202, good[7][:100] + " " + leak + " tail of it", "s2"), (203, None, "s2"), (204, "", None)]
    make(*rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(100 + i, 0, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cols, ids = docs.columns, []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(P.STAGES) - 1:
            assert out.columns == cols
            out.write.parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
            ids.append({x.doc_id for x in docs.collect()})
    first = ids[0]
    assert len(first & set(range(80))) >= 76 and len(first & set(range(100, 160))) <= 3
    assert {200, 201} & ids[1] == set() or not {5, 6} <= first
    assert ids[2] == ids[1]
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{tmp_path}/2").collect()}
    if 202 in text:
        assert leak not in text[202]
    assert ids[3] <= ids[2]
    blocks = P.run(spark, str(tmp_path)).collect()
    assert {d for b in blocks for d in b.doc_ids} == ids[3]
    assert {quality, ngram_join, decontam, mixing, token_coder}


def test_order_of_the_stages():
    assert [f.__name__ for _, f in P.STAGES] == ["quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "token_output"]


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder, docs, labels, bench):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def scheduled(rows, block):
    """Documents (doc_id, source, text) in the order of the schedule, by the rules of mixing, over lists."""
    size = lambda t: len(re.findall(r"[^ \n\r\t]+", t or ""))
    place = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:8], 16)
    streams = {}
    for d, s, t in rows:
        if size(t):
            streams.setdefault(s, []).append((place(d), (d is not None, d or 0), size(t), d, t))
    names = sorted(streams, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in streams[s]) for s in names}
    blocks = {s: -(-total[s] // block) for s in names}
    first = {}
    for s in names:
        begin = 0
        for _, _, n, d, t in sorted(streams[s], key=lambda x: x[:3]):
            first.setdefault((s, begin // block), []).append((d, t))
            begin += n
    weights = {s: math.isqrt(total[s]) for s in names}
    cuts, upto, every = [], 0, sum(weights.values())
    for s in names:
        upto += weights[s]
        cuts.append(upto * mixing.M // every)
    used, out = dict.fromkeys(names, 0), []
    for slot in range(sum(blocks.values())):
        u = slot % mixing.M * mixing.PHI % mixing.M
        s = names[next(k for k, c in enumerate(cuts) if u < c)]
        out += first.get((s, used[s] % blocks[s]), [])
        used[s] += 1
    return out + [(d, t) for d, s, t in rows if not size(t)]


def test_the_whole_against_brute_force(spark, tmp_path, make):
    """Every stage by definitions, over lists."""
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeilnorst") for _ in range(r.randint(2, 8)))
    leak = " ".join(word() for _ in range(25))
    texts = [" ".join(word() for _ in range(r.randint(15, 120))) for _ in range(90)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(100 + i, t.upper().replace(" ", "!! "), "s0") for i, t in enumerate(texts[:50])]
    rows += [(200 + i, t + " " + word(), "s1") for i, t in enumerate(texts[10:30])] + [(300 + i, t, "s2") for i, t in enumerate(texts[:15])]
    rows += [(400 + i, " ".join(word() for _ in range(30)) + " " + leak[i:] + " " + word(), None) for i in range(6)]
    rows += [(500, None, "s1"), (501, "", "s2"), (502, "  \n ", "s0")]
    labels = [(i, 1, 0) for i in range(90)] + [(100 + i, 0, 0) for i in range(50)]
    folder = tables(spark, tmp_path, make(*rows).select(*COLUMNS), labels, [(1, leak), (2, None), (3, "")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    net = quality.train(*quality.sample(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    now = [x for x in rows if test_quality.one_by_one(net, x[1]) >= quality.THRESHOLD]
    kept = {c for _, c, _ in test_ngram_join.brute([x[:2] for x in now], ngram_join.NGRAM, ngram_join.THRESHOLD)}
    now = [x for x in now if x[0] in kept]
    spans = {}
    for d, a, b in test_decontam.brute([x[:2] for x in now], [leak], decontam.PHRASE_WORDS):
        spans.setdefault(d, []).append((a, b))
    cut = []
    for d, t, s in now:
        at = [m.span() for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", t.lower())] if t else []
        for a, b in reversed(spans.get(d, [])):
            t = t[: at[a][0]] + t[at[b - 1][1] :]
        cut.append((d, s, t))
    order = scheduled(cut, mixing.BLOCK_TOKENS)
    one = token_coder.Tokenizer().one
    want = Counter((d, tuple(one.encode_ordinary(t or ""))) for d, t in order)

    blocks = P.run(spark, folder)
    got, parts = Counter(), {}
    for x in sorted(token_coder.documents_of(blocks).collect(), key=lambda x: (x.doc_id, x.first_token)):
        parts.setdefault(x.doc_id, []).append((x.first_token, tuple(x.ids)))
    for d, pieces in parts.items():
        times = sum(f == 0 for f, _ in pieces)
        assert len(pieces) % times == 0
        got[d, tuple(i for f, ids in pieces[::times] for i in ids)] += times
    assert got == want and spans and len(now) < len(rows)


def test_odd_and_empty_tables(spark, tmp_path, odd, none):
    for name, docs in (("odd", odd), ("none", none)):
        folder = tables(spark, tmp_path / name, docs.select(*COLUMNS), [(1, 1, 0), (5, 1, 0), (7, 0, 0), (None, 1, 0)] if name == "odd" else [], [(1, "the same text of a few words here")])
        blocks = P.run(spark, folder).collect()
        assert not blocks if name == "none" else blocks
    clash = odd.withColumnsRenamed({"label": "_row", "size": "slot", "bucket": "begin", "token": "_uid"})
    folder = tables(spark, tmp_path / "clash", clash, [(1, 1, 0)], [(1, "nothing")])
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert out.columns == clash.columns and out.count() > 0
