"""The language model's forward pass, temperature and rejection, against plain Python."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from tonemill.llm import language
from tonemill.llm.common import _BYTE, _STEP, crc_mod
from tonemill.llm.hashed import counts_of, labelled_sample


def mixed(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) % 2**64
    return x ^ (x >> 31)


def plain_shares(model, text):
    body = b" " + text.lower().encode() + b" "
    grams = [body[i : i + language.GRAM] for i in range(len(body) - language.GRAM + 1)]
    hidden = [0.0] * language.WIDTH
    for g in grams:
        h = int(_BYTE[g[0]])
        for byte in g[1:]:
            h = (h * int(_STEP) + int(_BYTE[byte])) % 2**64
        for k, x in enumerate(model.embedding[mixed(h) % language.DIMS].tolist()):
            hidden[k] += x / len(grams)
    z = [(sum(hidden[k] * float(model.layer[k, j]) for k in range(language.WIDTH)) + float(model.bias[j])) / model.temperature for j in range(len(model.languages))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, language.fit(docs)


def test_query_equals_plain_forward_pass(fitted):
    docs, model = fitted
    some = docs.where("doc_id < 150")
    texts = {r.doc_id: r.text for r in some.collect()}
    for r in language.identify(some, model).collect():
        text = texts[r.doc_id]
        if not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        shares = plain_shares(model, text[:100_000])
        assert r.score == pytest.approx(max(shares), abs=2e-3)
        if sorted(shares)[-1] - sorted(shares)[-2] > 1e-2:
            assert r.lang_pred == model.languages[int(np.argmax(shares))]
        assert r.rejected == (r.score < round(model.least, 6))


def test_temperature_is_calibrated(fitted):
    """No other temperature of the grid, nor 1, gives a smaller loss on the rows kept aside; a mean score is near the share right."""
    docs, model = fitted
    known = docs.where(crc_mod(F.col("doc_id"), 4) != 2).select("doc_id", F.col("lang").alias("label"))
    counts, names = labelled_sample(docs, known, language.SAMPLE, language.DIMS, language.GRAM, True)
    again = language.fit_arrays(counts, names)
    assert (again.temperature, again.least) == (model.temperature, model.least)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language.identify(docs, model).collect() if r.held_out and r.lang_pred != "und"]
    right = np.array([r.lang_pred == truth[r.doc_id] for r in rows])
    assert abs(right.mean() - np.mean([r.score for r in rows])) < 0.05


def test_accepted_rows_are_right(fitted):
    docs, model = fitted
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in language.identify(docs, model).collect() if r.held_out and not r.rejected]
    assert len(rows) > 150 and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) >= language.ACCURACY - 0.01


def test_rejection_by_hand():
    """Rows are accepted down to the score at which those above are right as often as asked; with noise few or none are."""
    rng = np.random.default_rng(0)
    texts = [b"aaa bbb", b"ccc ddd"] * 60
    counts = counts_of(texts, language.DIMS, language.GRAM)
    clear = language.fit_arrays(counts, ["x", "y"] * 60)
    assert (clear.shares(counts).max(1) >= clear.least - 1e-9).all()
    noise = language.fit_arrays(counts, rng.choice(["x", "y"], 120).tolist(), accuracy=1.01)
    assert noise.least == 1.0 and not language.fit_arrays(counts[:0], []).languages
