"""Packing: round trip, full windows, the solver."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tonemill.llm import packing
from tonemill.llm.tokens import Encoder, word_bpe_path


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe_path())


TEXTS = ["", "Plain words, twice words.", "it's they'll I'D we've, ok.", "Éclair façade; naïve, Straße.", "a b c\u0085d", "x<|endoftext|>y <|startoftext|>", "é J̌, İstanbul ΣΊΣΥΦΟΣ.", "数字1234 ½ ... a.b,c,, end,.", "\t \n", "tail,́", "가각 ᄀ", "don't.\nCan't,"]


def test_ids_are_the_tokenizers():
    own, plain = Encoder(word_bpe_path(), limit=8), tokenizer()
    for _ in range(2):
        for text, ids in zip(TEXTS, own.ids(TEXTS), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def check(docs, rows, window=packing.WINDOW):
    plain = tokenizer()
    coded = [(r["doc_id"], np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in docs.collect()]
    want = Counter()
    for d, ids in coded:
        at = 0
        for n in packing.cuts(len(ids) // 4):
            want[d, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4] += 1
            at += n
        assert at == len(ids) // 4
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    return by


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    by = check(docs, packing.pack(docs).collect())
    total = sum(n for p in by.values() for _, n in p)
    assert len(by) <= total / packing.WINDOW + 3


def test_edges(spark, edge_docs, no_docs):
    check(edge_docs, packing.pack(edge_docs).collect())
    assert packing.pack(no_docs).count() == 0


def test_sequences_hold_the_ids(spark, edge_docs):
    rows = packing.sequences(edge_docs).collect()
    ids = {r["sequence_id"]: bytes(r["ids"]) for r in rows}
    places = Counter((r["sequence_id"], d["offset"], d["doc_id"], d["start"], d["length"]) for r in rows for d in r["docs"])
    pieces = packing.pack(edge_docs).collect()
    assert any(r["doc_id"] is None for r in pieces)
    assert places == Counter((r["sequence_id"], r["offset"], r["doc_id"], r["start"], r["length"]) for r in pieces)
    for r in pieces:
        assert zlib.crc32(ids[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])]) == r["ids_crc32"]


@pytest.mark.parametrize("lengths", [[40 * 64] * 50, [63] * 700, [1], [4095] * 3 + [1] * 3, [4096] * 5, list(range(1, 4096, 7)), [64 * 21] * 90])
def test_layouts(lengths):
    counts = Counter(x for n in lengths for x in packing.cuts(n))
    layout, fill = packing.Layout(dict(counts)), {}
    for k, n in counts.items():
        sequence, offset = layout.place(np.full(n, k), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            fill.setdefault(s, []).append((o, k))
    assert sorted(fill) == list(range(layout.sequences))
    for pieces in fill.values():
        at = 0
        for o, k in sorted(pieces):
            assert o == at
            at += k
        assert at <= packing.WINDOW


def test_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(5):
        a, x = rng.random((6, 20)), np.zeros(20)
        x[rng.choice(20, 3, replace=False)] = rng.random(3) * 5
        got = packing.nnls(a, a @ x)
        assert (got >= 0).all()
        np.testing.assert_allclose(a @ got, a @ x, atol=1e-6)
    assert packing.nnls(np.eye(2), np.array([1.0, -1.0])).tolist() == [1.0, 0.0]
