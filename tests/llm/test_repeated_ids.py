"""Rows that repeat an id, or have none, and names that the operators themselves add."""

import numpy as np
from pyspark.sql import functions as F

from tonemill.llm import exact_dedup, ngram_jaccard, substring_dedup


def test_substring_ids_of_two_texts(spark):
    """A row loses what it shares with a smaller id, whatever other rows of its id hold."""
    words = lambda p, n=20: " ".join(f"{p}{i}" for i in range(n))
    rows = [(1, words("p")), (2, words("p")), (2, words("q")), (2, "x " + words("p") + " y"), (3, words("q")), (3, words("q"))]
    got = {(r.doc_id, r.kept_text, r.n_removed) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {(1, words("p"), 0), (2, "", 20), (2, words("q"), 0), (2, "x y", 20), (3, "", 20)}


def test_substring_one_word_through_a_long_text(spark, monkeypatch):
    """A super-k-mer as long as its text is cut; what a task holds is bounded in bytes."""
    monkeypatch.setattr(substring_dedup, "LONGEST", 50)
    monkeypatch.setattr(substring_dedup, "BYTES", 400)
    rows = [(1, "a " * 700), (2, "b c " + "a " * 300 + "d"), (3, "a " * 12), (4, "d " * 5000)]
    for parts in (1, 4):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(parts)).collect()}
        assert got[2] == (303, 300, "b c d") and got[3][1] == 0 and got[1][1] == 0 and got[4][1] == 0


def test_substring_beyond_the_broadcast(spark, monkeypatch, edge_docs):
    few = sorted(map(str, substring_dedup.without_repeats(edge_docs).collect()))
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(str, substring_dedup.without_repeats(edge_docs).collect())) == few


def test_jaccard_of_many_null_ids(spark, monkeypatch):
    """Whole sets of rows without an id meet their classes by hash: as many joined rows as rows, in more than one task."""
    rng = np.random.default_rng(0)
    rows = [(None, " ".join(f"g{i // 2}w{j}" for j in range(30)) + (" end" if i % 2 else "")) for i in range(1000)]
    rows += [(i, " ".join(f"o{k}" for k in rng.integers(0, 10**6, 30))) for i in range(50)]
    seen = []
    build = ngram_jaccard.with_sets

    def counted(docs, wanted, size):
        out = build(docs, wanted, size).cache()
        seen.append((wanted.count(), out.count()))
        return out

    monkeypatch.setattr(ngram_jaccard, "with_sets", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_jaccard.similar_documents(df).collect()
    assert sorted(r.n_links for r in got) == [0] * 50 + [1] * 1000 and {r.component_id for r in got if r.n_links} == {None}
    assert seen == [(1000, 1000)]
    kept = ngram_jaccard.keep_one(df)
    assert kept.count() == 550


def test_first_of_twins(spark):
    """Columns called like those that code adds; of twins the one of the least text stays, null and empty texts among them."""
    rows = [(1, "a  b", "x", 1), (1, "a b", "y", 2), (2, "a b", "z", 3), (3, None, "n", 4), (3, None, "m", 5), (3, "", "e", 6), (4, "c", "q", 7), (4, "c", "q", 7), (None, "d e", "u", 8), (None, "d\te", "v", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `its text` string, `r.t` int").withColumns({n: F.lit(1) for n in ("h", "norm", "gone_id", "twin_h", "row", "fp", "a`b")}).repartition(3)
    got = exact_dedup.keep_first(df)
    assert got.columns == df.columns
    found = sorted((str(r.doc_id), r.text) for r in got.collect())
    assert found[:3] == [("1", "a  b"), ("3", None), ("4", "c")] and found[3][0] == "None" and len(found) == 4
