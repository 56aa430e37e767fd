import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import token_coder as C
from sparkloom.llm.common import string_buffers


@pytest.fixture(scope="module")
def tokenizer():
    return C.Tokenizer()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab Z9.'\n\t\r é東  \x1c\x85s!", max_size=25), min_size=1, max_size=6))
def test_ids_are_the_tokenizers_own(tokenizer, texts):
    raw, offsets = string_buffers(pa.array(texts), lower=False)
    ids, upto = tokenizer.encode(raw, offsets)
    for t, a, b in zip(texts, upto, upto[1:]):
        assert ids[a:b].tolist() == tokenizer.one.encode_ordinary(t)


@settings(max_examples=40, deadline=None)
@given(st.integers(2, 300), st.integers(0, 2**32 - 1), st.lists(st.integers(0, 700), min_size=1, max_size=5))
def test_round_trip(n_ids, seed, sizes):
    g = np.random.default_rng(seed)
    blocks = [(g.zipf(1.3, n) % n_ids).astype(np.int32) for n in sizes]
    coded = C.code([C.intervals(b, n_ids) for b in blocks])
    for b, c in zip(blocks, coded):
        assert (C.decode(c, len(b), n_ids) == b).all()


def test_intervals_part_the_total():
    """Every next id has its own interval, and together they are the total."""
    g = np.random.default_rng(3)
    x = (g.zipf(1.5, 400) % 9).astype(np.int32)
    for at in (0, 1, 2, 3, 130, 399):
        parts = []
        for s in range(9):
            y = x[: at + 1].copy()
            y[at] = s
            begin, width = C.intervals(y, 9)
            parts.append((int(begin[at]), int(width[at])))
        edge = 0
        for begin, width in parts:
            assert begin == edge and width > 0
            edge += width
        assert edge == C.TOTAL


def test_repetition_is_compressed():
    x = np.tile(np.arange(50, dtype=np.int32), 100)
    assert len(C.code([C.intervals(x, 1000)])[0]) < len(x) / 4
    g = np.random.default_rng(0)
    y = g.integers(0, 1000, 5000).astype(np.int32)
    assert len(C.code([C.intervals(y, 1000)])[0]) < 2 * len(y)


def test_table_round_trip(odd, none, tokenizer):
    for size in (64, 16384):
        blocks = C.token_blocks(odd, block_tokens=size)
        rows = blocks.collect()
        assert all(r.block_tokens == sum(r.n_tokens) for r in rows)
        got = {}
        for r in C.documents_of(blocks).collect():
            got.setdefault(r.doc_id, []).append((r.first_token, list(r.ids)))
        texts = {}
        for r in odd.collect():
            texts.setdefault(r.doc_id, []).append(tokenizer.one.encode_ordinary(r.text or ""))
        assert got.keys() == texts.keys()
        for d in (1, 3, 4, 5, 6, 7, 8):
            assert [x for _, ids in sorted(got[d]) for x in ids] == texts[d][0]
    assert C.token_blocks(none).count() == 0


def test_a_damaged_block_is_noticed(tokenizer):
    x = np.arange(300, dtype=np.int32)
    block = {"payload": C.code([C.intervals(x, tokenizer.n_ids)])[0], "block_tokens": 300, "crc32": zlib.crc32(x.astype("<u4").tobytes())}
    assert (C.checked(block, tokenizer.n_ids) == x).all()
    block["payload"] = block["payload"][:40] + bytes([block["payload"][40] ^ 1]) + block["payload"][41:]
    with pytest.raises(ValueError, match="damaged"):
        C.checked(block, tokenizer.n_ids)


def test_blocks_are_bounded(none):
    with pytest.raises(ValueError, match="65536"):
        C.token_blocks(none, block_tokens=1 << 17)


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    """With hashes of three values nearly all pieces are mistaken for others; the comparison of bytes finds it."""
    plain = C.span_hashes
    monkeypatch.setattr(C, "span_hashes", lambda raw, a, b: plain(raw, a, b) % np.uint64(3))
    t = C.Tokenizer()
    texts = ["one two three four", "", "five six seven", "one one"]
    raw, offsets = string_buffers(pa.array(texts), lower=False)
    ids, upto = t.encode(raw, offsets)
    for x, a, b in zip(texts, upto, upto[1:]):
        assert ids[a:b].tolist() == t.one.encode_ordinary(x)


def test_ids_must_be_integers(make):
    docs = make((1, "a"))
    assert C.token_blocks(docs.withColumn("doc_id", docs.doc_id.cast("int"))).first().doc_ids == [1]
    with pytest.raises(TypeError, match="integer"):
        C.token_blocks(docs.withColumn("doc_id", docs.doc_id.cast("string")))
