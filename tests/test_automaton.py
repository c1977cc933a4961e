"""The trie walk against str.count and `in`."""

import random

import pytest
from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill.functions import automaton, scoring

LISTS = {"nested": ("need", "needs", "needs to", "violation", "violations"), "overlapping": ("aa", "aba", "abab", "a", "ana"), "other": ("é", "数字", "naïve é", " ", "aa", "aa")}


def test_counts_equal_str_count(spark, monkeypatch):
    rng = random.Random(1)
    pieces = ["need", "needs to", "violations", "aaaa", "ababab", "banana", "é", "数字", "naïve é", " ", "b", "x\n"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(300)] + [None, "", "a" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    got = {r.id: r for r in df.select("id", automaton.list_counts(F.col("t"), LISTS).alias("n"), automaton.found_terms(F.col("t"), LISTS["overlapping"]).alias("f")).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n and got[i].n.asDict()) == (None if t is None else {k: sum(t.count(w) for w in v) for k, v in LISTS.items()})
        assert got[i].f == (None if t is None else [w for w in LISTS["overlapping"] if w in t])


def test_runs_of_rows_and_borders(monkeypatch):
    """Terms are not found across rows, whatever the size of runs."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(automaton, "BYTES", 5)
    trie = automaton.Trie(["ab", "bc"])
    texts = pa.array(["xxa", "b", None, "abc", "a" * 12 + "b", "", "bc"]).slice(1)
    found = []
    base = 0
    for body, rows in automaton.buffers(texts):
        row, term, _ = trie.occurrences(body, rows)
        found += [(base + r, t) for r, t in zip(row.tolist(), term.tolist(), strict=True)]
        base += len(rows) - 1
    assert base == 6 and sorted(found) == [(2, 0), (2, 1), (3, 0), (5, 1)]
    assert trie.overlaps.tolist() == [False, False] and automaton.Trie(["aa", "abca", "ab"]).overlaps.tolist() == [True, True, False]
    assert len(list(automaton.buffers(pa.array([], pa.string())))) == 0
    with pytest.raises(ValueError, match="empty"):
        automaton.Trie([""])
    assert np.array_equal(trie.sizes, [2, 2])


def test_fixed_lists(spark):
    text = "The failed court has yet to meet; Violations of needs to be, limited progress. No trial: industrial."
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    lists = {"hard": L.CRITICISM_HARD, "soft": L.CRITICISM_SOFT, **L.TOPICS_FOUR}
    n, low = df.select(scoring.raw_counts(F.col("t"), lists).alias("n")).collect()[0].n, text.lower()
    assert n.asDict() == {k: sum(low.count(w) for w in v) for k, v in lists.items()}
