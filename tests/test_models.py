"""Regressions against numpy, stemmers against published examples, LDA's shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonemill.models import regression as M
from tonemill.models import stem, topics
from tonemill.operators import segment
from tonemill.plans import catalog


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 600
    g = rng.integers(0, 6, n)
    x, z = rng.normal(size=n), rng.normal(size=n)
    level = np.array(["a", "b", "c"])[rng.integers(0, 3, n)]
    eta = 0.4 * x - 0.7 * z + 0.5 * (level == "b") + 0.2 * g / 6
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)
    w = eta + rng.normal(size=n)
    rows = [(int(a), float(b), float(c), str(d), f"g{e}", float(f)) for a, b, c, d, e, f in zip(y, x, z, level, g, w, strict=True)]
    return spark.createDataFrame(rows, "y int, x double, z double, level string, g string, w double"), y, w, x, z, level, g


def dense(x, z, level):
    return np.column_stack([np.ones(len(x)), level == "b", level == "c", x, z]).astype(float)


def sandwich(x, residual, h, g):
    meat = sum(np.outer(s, s) for s in (x[g == k].T @ residual[g == k] for k in np.unique(g)))
    n, k, c = len(x), x.shape[1], len(np.unique(g))
    inv = np.linalg.inv(h)
    return c / (c - 1) * (n - 1) / (n - k) * inv @ meat @ inv


def test_logit_with_clusters(data):
    df, y, _, x, z, level, g = data
    d = M.design(df, "y", ["x", "z"], "level", "a", "g")
    got, robust = M.fit(d), M.fit(d, errors="cluster")
    a = dense(x, z, level)
    beta = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-a @ beta))
        h = (a * (p * (1 - p))[:, None]).T @ a
        beta = beta + np.linalg.solve(h, a.T @ (y - p))
    assert got.names == ["Intercept", "b", "c", "x", "z"]
    np.testing.assert_allclose(got.beta, beta, atol=1e-7)
    np.testing.assert_allclose(got.cov, np.linalg.inv(h), atol=1e-7)
    np.testing.assert_allclose(robust.cov, sandwich(a, y - p, h, g), atol=1e-7)


def test_least_squares_with_clusters(data):
    df, _, w, x, z, level, g = data
    got = M.fit(M.design(df, "w", ["x", "z"], "level", "a", "g"), "ols", "cluster")
    a = dense(x, z, level)
    beta = np.linalg.lstsq(a, w, rcond=None)[0]
    np.testing.assert_allclose(got.beta, beta, atol=1e-7)
    np.testing.assert_allclose(got.cov, sandwich(a, w - a @ beta, a.T @ a, g), atol=1e-7)


def test_joint_fits_equal_single_ones(spark, data):
    """Outcomes of one design, each with nulls of its own, against fits of each alone; rounds and convergence are told."""
    df = data[0].withColumn("y", F.when(F.col("x") < 1.5, F.col("y"))).withColumn("w", F.when(F.col("z") > -1.5, F.col("w")))
    for errors in ("default", "cluster"):
        joint = M.fit_joint(M.design(df, ["y", "w"], ["x", "z"], "level", "a", "g"), ["logit", "ols"], errors)
        for got, name, family in zip(joint, ("y", "w"), ("logit", "ols"), strict=True):
            alone = M.fit(M.design(df, name, ["x", "z"], "level", "a", "g"), family, errors)
            assert got.n == alone.n and got.converged and got.rounds == alone.rounds
            np.testing.assert_allclose(got.beta, alone.beta, atol=1e-9)
            np.testing.assert_allclose(got.cov, alone.cov, atol=1e-9)
    apart = spark.createDataFrame([(float(i), int(i > 5)) for i in range(12)], "x double, y int")
    assert not M.fit(M.design(apart, "y", ["x"]), rounds=8).converged


@pytest.mark.parametrize(("formula", "how"), [
    ("y ~ C(level, Treatment('a')) + x + z", {"y": "y", "numeric": ["x", "z"], "factor": "level", "base": "a"}),
    ("y~x+C(level,Sum)", {"y": "y", "numeric": ["x"], "factor": "level", "coding": "sum"}),
    ("y + w ~ C(level) + x*z", {"y": ["y", "w"], "numeric": ["x", "z"], "factor": "level", "interactions": [("x", "z")]}),
    ("w ~ C(level)*x + z + z", {"y": "w", "numeric": ["x", "z"], "factor": "level", "interactions": [("x", "b"), ("x", "c")]}),
    ("w ~ x + z + x:z", {"y": "w", "numeric": ["x", "z"], "interactions": [("x", "z")]}),
])
def test_formulas(data, formula, how):
    got, want = M.from_formula(data[0], formula, "g"), M.design(data[0], cluster="g", **how)
    assert (got.names, got.outcomes) == (want.names, want.outcomes)
    assert sorted(map(tuple, got.rows.collect())) == sorted(map(tuple, want.rows.collect()))


@pytest.mark.parametrize("formula", ["y", "y ~", "~ x", "y ~ C(a) + C(b)", "y ~ log(x)", "y ~ a:b:c"])
def test_what_is_no_formula(data, formula):
    with pytest.raises(ValueError, match="is no|more than"):
        M.from_formula(data[0], formula)


def test_levels_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_LEVELS", 3)
    with pytest.raises(ValueError, match="levels"):
        M.design(spark.range(9).selectExpr("id as y", "cast(id as string) as f"), "y", [], "f")


def test_sum_coding_and_interactions(data):
    df = data[0]
    plain, deviation = M.fit(M.design(df, "y", ["x"], "level")), M.fit(M.design(df, "y", ["x"], "level", coding="sum"))
    effects = [0.0, plain.beta[1], plain.beta[2]]
    np.testing.assert_allclose(deviation.beta[1], effects[0] - np.mean(effects), atol=1e-7)
    assert M.design(df, "y", ["x", "z"], "level", interactions=[("x", "b")]).names[-1] == "x:b"


@pytest.mark.parametrize(("word", "root"), [("consigned", "consign"), ("knackeries", "knackeri"), ("generically", "generic"), ("hoping", "hope"), ("hopping", "hop"), ("skies", "sky"), ("running", "run"), ("violations", "violat"), ("relational", "relat")])
def test_revised_stemmer(word, root):
    assert stem.porter2(word) == root


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("filing", "file"), ("triplicate", "triplic"), ("controll", "control"), ("roll", "roll")])
def test_original_stemmer(word, root):
    assert stem.porter(word) == root


def test_stem_scores(spark):
    docs = spark.createDataFrame([(1, "He failed, they fail; limited progress. State capture"), (2, "")], "id long, text string")
    rows = {r["id"]: r for r in stem.stem_scores(docs, "id", "text", {"hard": ("failure", "failing", "state capture")}).collect()}
    assert (rows[1]["hard_raw"], rows[1]["n_tokens"]) == (3, 8)
    assert (rows[2]["hard_raw"], rows[2]["hard_p1k"]) == (0, 0.0)


def test_topics(spark):
    docs = spark.createDataFrame([(i, ["court", "judge", "law"] if i % 2 else ["market", "growth", "trade"]) for i in range(20)], "id long, tokens array<string>")
    model, words, vectors = topics.fit_lda(docs, "tokens", 2, 5, min_df=1, max_df=1.0)
    assert topics.topic_terms(model, words, 3).count() == 6
    w = topics.topic_weights(model, vectors, ["id"]).select(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x).alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-6 for r in w)
    assert topics.perplexity(model, vectors) > 0


def test_topics_pass_over_all_documents(spark, monkeypatch):
    """Each round sees every document, and there are as many rounds as asked for."""
    seen = []
    fit = topics.LDA.fit
    monkeypatch.setattr(topics.LDA, "fit", lambda self, df: seen.append((self.getSubsamplingRate(), self.getMaxIter())) or fit(self, df))
    docs = spark.createDataFrame([(i, ["court", "judge", "law"] if i % 2 else ["market", "growth", "trade"]) for i in range(20)], "id long, tokens array<string>")
    topics.fit_lda(docs, "tokens", 2, min_df=1, max_df=1.0)
    assert seen == [(1.0, 20)]


@pytest.mark.parametrize(("most", "low", "high"), [(100, 2, 0.6), (100, 1, 1.0), (100, 0.3, 0.9), (3, 1, 1.0)])
def test_known_terms_are_those_of_the_count_vectorizer(spark, most, low, high):
    from pyspark.ml.feature import CountVectorizer

    lists = [["a"] * 9 + ["b"] * 5, ["a", "b", "c", "c", "c"], ["a", "d", "d"], [], ["e", "a"]]
    docs = spark.createDataFrame([(t,) for t in lists], "tokens array<string>").repartition(2)
    want = CountVectorizer(inputCol="tokens", outputCol="n", vocabSize=most, minDF=low, maxDF=high if high < 1 else 2.0**53).fit(docs).vocabulary
    assert topics.known_terms(docs, "tokens", most, low, high) == want


def test_fit_lda_keeps_no_token_lists(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ["a", "b", f"w{i % 3}"]) for i in range(12)], "id int, tokens array<string>")
    fit, held = topics.LDA.fit, []
    own = spark.sparkContext._jsc
    before = set(own.getPersistentRDDs())
    monkeypatch.setattr("pyspark.ml.feature.CountVectorizer.fit", None)
    monkeypatch.setattr(topics.LDA, "fit", lambda self, df: held.append(set(own.getPersistentRDDs()) - before) or fit(self, df))
    topics.fit_lda(docs, "tokens", 2, 2, min_df=1, max_df=0.9)
    assert all(len(h) <= 1 for h in held)


def test_stem_scores_count_in_the_row(spark):
    rows = [(1, "Failing failed fail, failure of state capture"), (2, ""), (3, None), (4, "none here")]
    out = stem.stem_scores(spark.createDataFrame(rows, "id int, text string"), "id", "text", {"hard": ("failing",), "soft": ("of state",)})
    assert {r["id"]: (r["n_tokens"], r["hard_raw"], r["soft_raw"]) for r in out.collect()} == {1: (7, 3, 1), 2: (0, 0, 0), 3: (None, 0, None), 4: (2, 0, 0)}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_known_ngrams_are_those_of_listed_ngrams(spark):
    docs = spark.createDataFrame([(["a", "b", "a", "b"],), (["b", "a"],), (["c"],), ([],), (None,), (["a", "b", "c"],)], "tokens array<string>")
    listed = docs.select(segment.ngrams(F.col("tokens"), 1, 2).alias("tokens"))
    assert topics.known_terms(docs, "tokens", 5, 2, 0.9, 1, 2) == topics.known_terms(listed, "tokens", 5, 2, 0.9) and "a b" in topics.known_terms(docs, "tokens", 5, 2, 0.9, 1, 2)


def test_phrase_topics_judge_held_vectors(spark, sf, monkeypatch):
    held, perplexity = [], topics.perplexity
    monkeypatch.setattr(topics, "perplexity", lambda model, vectors: held.append(vectors.storageLevel.useMemory) or perplexity(model, vectors))
    assert catalog.queries()["lda_phrase_topics"](spark, sf).count() == 84
    assert held == [True]
