"""Result tables of the batch pipeline: regressions, fitted rates, odds ratios, sensitivity to paragraph bounds, topic weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill.functions import scoring as S
from tonemill.functions import text as X
from tonemill.models import regression as M
from tonemill.models import stem, topics
from tonemill.operators import relate as R
from tonemill.operators import segment as G
from tonemill.session import cut, share_package

OUTCOMES = {"hard_flag": "logit", "soft_flag": "logit", "severity_ratio": "ols"}
SWEEP = {"baseline": (50, 500), "min_30": (30, 500), "max_300": (50, 300)}


def regression_input(scores: DataFrame) -> DataFrame:
    """country, flags, ratio, topics and the centred year of paragraphs of the entities that have every year; numbers only."""
    years = scores.select("year").distinct().count()
    full = R.complete_entities(scores.select("country", "year"), "country", "year", years)
    found = [c for c in scores.columns if c.startswith("topic_")]
    rows = scores.join(F.broadcast(full), "country", "left_semi")
    flags = {f"{n}_flag": (F.col(f"criticism_{n}_p1k") > 0).cast("int") for n in ("hard", "soft")}
    rows = cut(rows.select("country", "year", "severity_ratio", *(c.alias(n) for n, c in flags.items()), *(F.col(c).cast("int").alias(c) for c in found)))
    return rows.crossJoin(F.broadcast(rows.agg(F.median("year").alias("mid")))).withColumn("year_c", F.col("year") - F.col("mid")).drop("mid")


def regression_tables(scores: DataFrame, base: str | None = None) -> dict[str, DataFrame]:
    """spec_b_regression, topic_odds_ratios, hard_flag_probabilities: three outcomes on entity, topics and year, errors by entity."""
    spark, rows = scores.sparkSession, regression_input(scores)
    found = [c for c in rows.columns if c.startswith("topic_")]
    design = M.design(rows, list(OUTCOMES), [*found, "year_c"], "country", base, "country")
    fits = dict(zip(OUTCOMES, M.fit_joint(design, list(OUTCOMES.values()), "cluster"), strict=True))
    long = spark.createDataFrame([(name, i, *r) for name, f in fits.items() for i, r in enumerate(f.table())], "outcome string, at int, term string, coef double, se double, z double, p double, low double, high double, odds double")
    number = lambda c: F.format_string("%.3f", c)
    shown = F.concat(number(F.coalesce("odds", "coef")), X.stars(F.col("p")))
    label = F.replace(F.replace(F.col("term"), F.lit("topic_"), F.lit("")), F.lit("_"), F.lit(" "))
    wide = long.groupBy("at", label.alias("term")).agg(*(F.max(F.when(F.col("outcome") == name, shown)).alias(name) for name in OUTCOMES))
    odds = long.where((F.col("outcome") == "hard_flag") & F.col("term").isin(*found)) if found else long.where("false")
    span = X.interval(F.exp("low"), F.exp("high"))
    fitted = M.predicted(M.Design(design.rows.withColumn("y", F.col("y0")), design.names), fits["hard_flag"])
    rates = fitted.groupBy(F.col("cluster").alias("country")).agg(F.avg("y").alias("observed"), F.avg("fitted").alias("fitted"))
    return {
        "spec_b_regression": wide.orderBy("at").drop("at"),
        "topic_odds_ratios": odds.orderBy("at").select(label.alias("topic"), F.concat(number(F.col("odds")), X.stars(F.col("p"))).alias("odds_ratio"), span.alias("ci_95")),
        "hard_flag_probabilities": rates.withColumn("difference", F.col("fitted") - F.col("observed")).orderBy(F.desc("fitted"), "country"),
    }


def sensitivity(reports: DataFrame, hard=L.CRITICISM_HARD, bounds=None) -> DataFrame:
    """country, a mean of year means for each paragraph bound, and the change of each against the first; texts are cut once."""
    bounds = bounds or SWEEP
    p = G.sweep_corpus(reports, bounds).select("country", "year", "bounds", S.dict_score(F.col("paragraph_text"), hard).alias("m"))
    yearly = p.select("country", "year", F.explode("bounds").alias("of"), "m").groupBy("country", "year", "of").agg(F.round(F.avg("m"), 4).alias("m"))
    means = yearly.groupBy("country", "of").agg(F.round(F.avg("m"), 3).alias("m"))
    out = means.groupBy("country").agg(*(F.max(F.when(F.col("of") == n, F.col("m"))).alias(n) for n in bounds))
    first = F.col(next(iter(bounds)))
    return out.select("country", *bounds, *(X.percent_change(F.col(n), first).alias(f"{n}_change") for n in list(bounds)[1:]))


def topic_weights(reports: DataFrame, k: int = 3, rounds: int = 20, size: int = 5, least: int = 6) -> DataFrame:
    """country, year, chunk and the weights topic_1, ..., topic_k of each chunk of five sentences, by a topic model of their stems."""
    share_package(reports.sparkSession)
    chunks = reports.select("country", "year", F.posexplode(G.fixed_chunks(G.sentences(F.col("text"), 1), size)).alias("chunk", "text"))
    stems = stem.stem_lists(G.alphabetic_tokens(F.col("text"), 4), stem.porter)
    chunks = cut(chunks.select("country", "year", "chunk", stems.alias("stems")).where(F.size("stems") >= least))
    model, _, vectors = topics.fit_lda(chunks, "stems", k, rounds, min_df=1, max_df=1, vocabulary=1 << 18)
    weights = topics.topic_weights(model, vectors, ["country", "year", "chunk"])
    return weights.select("country", "year", "chunk", *(F.col("weights")[i].alias(f"topic_{i + 1}") for i in range(k)))
