import random

import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and blank texts, ties, repeated rows, a very long text, extra columns with clashing names."""
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdeéñ", k=rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    base = text(80)
    words = base.split()
    near = " ".join(words[:79] + ["changed"])
    passage = text(60)
    rows = [
        (1, base, "en"), (2, base.replace(" ", "\n", 3), "en"), (3, near, None), (4, None, "en"), (5, "", "fr"), (6, " \t\n ", "fr"),
        (7, passage + " " + text(40), "en"), (8, text(30) + " " + passage, "en"), (9, "a b c", "en"), (10, "A b  c", "en"),
        (11, text(60_000), "en"), (None, base, "en"), (12, "Ünïcode 数字 text", None), (13, "1234 !!", "en"), (14, "dup row", "en"), (14, "dup row", "en"),
    ]
    rows = [(*r, i, 1, "x", 0.5) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, kept int, keep_id string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
