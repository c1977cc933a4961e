"""Queries: regressions, topic models and stem scores. SQL cannot state them; tests compare them with numpy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill.functions import scoring as S
from tonemill.models import regression as M
from tonemill.models import sentences, stem, topics
from tonemill.operators import segment as G
from tonemill.plans.adapter import SCORED, paragraphs, scored, table
from tonemill.plans.registry import query
from tonemill.session import cut, share_package

TOPIC_COLUMNS = [f"topic_{t}" for t in L.PROXY_TOPICS]


def sample(spark, sf_dir):
    """Labelled documents: outcomes, a ratio, topic flags, centred year, entity (language) and cluster (source)."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    df = docs.where("text is not null").join(labels, "doc_id")
    df = df.withColumns(S.topic_flags(F.col("text"), L.PROXY_TOPICS))
    hard, soft = S.dict_score(F.col("text"), L.PROXY_HARD), S.dict_score(F.col("text"), L.PROXY_SOFT)
    df = df.select("doc_id", "lang", "source", "quality", "toxic", (2019 + F.col("doc_id") % 7).alias("year"), S.severity(hard, soft).alias("severity"), *(F.col(c).cast("int").alias(c) for c in TOPIC_COLUMNS))
    df = cut(df)  # a few numbers a row, which medians, levels and every step of a fit read; texts are scored once
    return df.crossJoin(F.broadcast(df.agg(F.median("year").alias("mid")))).withColumn("year_c", F.col("year") - F.col("mid")).drop("mid")


def _design(df, y, **how):
    return M.design(df, y, [*TOPIC_COLUMNS, "year_c"], "lang", cluster="source", **how)


@query()
def default_logit(spark, sf_dir):
    return M.fit(_design(sample(spark, sf_dir), "toxic")).frame(spark, "toxic")


@query()
def clustered_models(spark, sf_dir):
    """Two logits and a least-squares fit with errors by cluster, odds ratios and intervals: one design, one pass a step for all."""
    outcomes = {"toxic": "logit", "quality": "logit", "severity": "ols"}
    fits = M.fit_joint(_design(sample(spark, sf_dir), list(outcomes), base="en"), list(outcomes.values()), "cluster")
    return reduce(DataFrame.unionByName, (f.frame(spark, y) for y, f in zip(outcomes, fits, strict=True)))


@query()
def error_comparison(spark, sf_dir):
    """Default beside clustered errors of the same coefficients."""
    d = _design(sample(spark, sf_dir), "toxic")
    plain, robust = M.fit(d).table(), M.fit(d, errors="cluster").table()
    return spark.createDataFrame([(p[0], p[1], p[2], r[2], p[4], r[4]) for p, r in zip(plain, robust, strict=True)], "term string, coef double, se_default double, se_cluster double, p_default double, p_cluster double")


@query()
def interaction_model(spark, sf_dir):
    d = M.design(sample(spark, sf_dir), "toxic", [*TOPIC_COLUMNS, "year_c"], "lang", cluster="source", interactions=[(c, "fr") for c in TOPIC_COLUMNS[:2]])
    return M.fit(d, errors="cluster").frame(spark, "toxic x fr")


@query()
def formula_models(spark, sf_dir):
    """Two outcomes of one formula, with the year's slope by language, errors by source."""
    d = M.from_formula(sample(spark, sf_dir), f"toxic + quality ~ C(lang, Treatment('en')) * year_c + {' + '.join(TOPIC_COLUMNS)}", "source")
    return reduce(DataFrame.unionByName, (f.frame(spark, y) for y, f in zip(("toxic", "quality"), M.fit_joint(d, ["logit", "logit"], "cluster"), strict=True)))


@query()
def deviation_coding(spark, sf_dir):
    return M.fit(_design(sample(spark, sf_dir), "toxic", coding="sum"), errors="cluster").frame(spark, "toxic, sum coding")


@query()
def recent_refit(spark, sf_dir):
    """The same model over the last years, the year centred anew."""
    df = sample(spark, sf_dir).where("year >= 2023").drop("year_c")
    df = df.crossJoin(F.broadcast(df.agg(F.median("year").alias("mid")))).withColumn("year_c", F.col("year") - F.col("mid"))
    return M.fit(_design(df, "toxic"), errors="cluster").frame(spark, "toxic since 2023")


@query()
def fitted_rates(spark, sf_dir):
    """Observed and fitted rates by cluster, and their difference."""
    d = _design(sample(spark, sf_dir), "quality")
    return M.predicted(d, M.fit(d)).groupBy("cluster").agg(F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg("fitted"), 6).alias("fitted")).withColumn("difference", F.round(F.col("observed") - F.col("fitted"), 6))


def _tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", (2019 + F.col("doc_id") % 7).cast("int").alias("year"), G.model_tokens(F.col("text")).alias("tokens"))


@query()
def lda_terms(spark, sf_dir):
    """The heaviest terms of each topic."""
    model, vocabulary, _ = topics.fit_lda(_tokens(spark, sf_dir), "tokens", 3)
    return topics.topic_terms(model, vocabulary)


@query()
def lda_phrase_topics(spark, sf_dir):
    """Seven topics over words and bigrams: the heaviest terms, and the model's perplexity."""
    docs = _tokens(spark, sf_dir).select("doc_id", "tokens")
    with topics.fitted(docs, "tokens", 7, low=1, high=2) as (model, vocabulary, _, held):
        perplexity = topics.perplexity(model, held)
    return topics.topic_terms(model, vocabulary).withColumn("perplexity", F.round(F.lit(perplexity), 1))


@query()
def trained_sentence_chunks(spark, sf_dir):
    """Chunks of five sentences, whose boundaries are learned from all documents."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    cut_up = docs.select("doc_id", sentences.sentences(F.col("text"), sentences.learn(docs)).alias("s"))
    return cut_up.select("doc_id", F.posexplode(G.fixed_chunks(F.col("s"), 5)).alias("chunk", "text"))


def _tokens_sql(text: str) -> str:
    bare = rf"""regexp_replace(regexp_replace(w, '^[("''“‘«\[{{]+', ''), '[)"''”’»\]}},;:!?]+$', '')"""
    return rf"""w AS (SELECT {bare} AS w FROM (SELECT unnest(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) AS w FROM {text})),
t AS (SELECT CASE WHEN regexp_full_match(kind, '-?[.,]?\d[\d,.-]*') THEN '##number##' ELSE kind END AS kind, period FROM (SELECT lower(regexp_replace(w, '\.+$', '')) AS kind, regexp_matches(w, '(^|[^.])\.$') AS period FROM w) WHERE regexp_matches(kind, '[\p{{L}}\d#]'))"""


@query(f"""WITH {_tokens_sql('documents')},
c AS (SELECT kind, count(*) FILTER (period) AS w, count(*) FILTER (NOT period) AS o FROM t WHERE kind <> '##number##' GROUP BY kind),
a AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (period)::DOUBLE AS p FROM t),
s AS (SELECT kind, w AS with_period, o AS without_period, length(replace(kind, '.', '')) AS letters, length(kind) - length(replace(kind, '.', '')) AS dots,
  -2 * (w * ln(p / n) + CASE WHEN o = 0 THEN 0 ELSE o * ln(1 - p / n) END - w * ln(0.99::DOUBLE) - CASE WHEN o = 0 THEN 0 ELSE o * ln(1 - 0.99::DOUBLE) END) AS r FROM c, a WHERE w > 0)
SELECT kind, with_period, without_period, round(r * exp(-letters::DOUBLE) * (dots + 1) * pow(letters::DOUBLE, -without_period::DOUBLE), 6) AS score FROM s WHERE r * exp(-letters::DOUBLE) * (dots + 1) * pow(letters::DOUBLE, -without_period::DOUBLE) >= 0.3""")
def learned_abbreviations(spark, sf_dir):
    """Abbreviations that are learned from all documents, with their counts and scores."""
    return sentences.abbreviation_scores(sentences.token_counts(table(spark, sf_dir, "documents"))).where(F.col("score") >= sentences.ABBREVIATION).withColumn("score", F.round("score", 6))


def stem_chunks(docs, size=5, least=6, stops=()):
    """doc_id, chunk, stems: of each `size` sentences the stems of wholly alphabetic tokens longer than three letters; chunks of fewer than `least` go."""
    share_package(docs.sparkSession)
    chunks = docs.select("doc_id", F.posexplode(G.fixed_chunks(F.col("sentences"), size)).alias("chunk", "text"))
    stems = stem.stem_lists(G.alphabetic_tokens(F.col("text"), 4, stops), stem.porter)
    return chunks.select("doc_id", "chunk", stems.alias("stems")).where(F.size("stems") >= least)


@query()
def lda_stem_topics(spark, sf_dir):
    """Three topics over the stems of chunks of five sentences."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", G.sentences(F.col("text"), 1).alias("sentences"))
    chunks = cut(stem_chunks(docs, stops=("that", "with", "this")))  # two readers
    model, vocabulary, _ = topics.fit_lda(chunks, "stems", 3, min_df=1, max_df=1, vocabulary=1 << 18)
    return topics.topic_terms(model, vocabulary)


@query()
def lda_year_weights(spark, sf_dir):
    """Mean topic weights by year."""
    model, _, vectors = topics.fit_lda(_tokens(spark, sf_dir), "tokens", 3)
    w = topics.topic_weights(model, vectors, ["doc_id", "year"])
    return w.groupBy("year").agg(*(F.round(F.avg(F.col("weights")[i]), 6).alias(f"topic_{i}") for i in range(3)))


@query()
def stem_scored_paragraphs(spark, sf_dir):
    """Single terms by stem, phrases as substrings, per thousand tokens."""
    p = paragraphs(spark, sf_dir).select(F.concat_ws(":", "doc_id", "paragraph_id").alias("id"), "paragraph_text")
    return stem.stem_scores(p, "id", "paragraph_text", {"hard": ("thing", "reed", "of the"), "soft": ("with", "ingly", "in the")})


@query()
def stemmed_vocabulary(spark, sf_dir):
    """Distinct tokens longer than three letters with their stems by the original stemmer."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    each = docs.select(F.explode(G.model_tokens(F.col("text"), ("the", "and"))).alias("token")).where(F.length("token") > 3)
    return stem.stems(each, "token", stem.porter)


@query(f"WITH {SCORED} SELECT country, round(avg(CAST(criticism_hard_p1k > 50 AS INTEGER)), 6) AS share FROM scored GROUP BY country")
def scored_topic_probabilities(spark, sf_dir):
    """Share of paragraphs with a high hard score by entity: the table behind a chart."""
    return scored(spark, sf_dir).groupBy("country").agg(F.round(F.avg((F.col("criticism_hard_p1k") > 50).cast("int")), 6).alias("share"))
