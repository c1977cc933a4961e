"""Group aggregations over scored rows; each is one partial and one final aggregate around a single shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonemill.functions.automaton import found_terms
from tonemill.operators.quantiles import exact_quantiles

METRICS = ("criticism_hard_p1k", "criticism_soft_p1k", "severity_ratio")


def _known(df: DataFrame, keys) -> DataFrame:
    """Group keys that are null are dropped."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df


def mean_by(df: DataFrame, keys, metrics=METRICS, places: int = 4) -> DataFrame:
    """Unweighted means, nulls left out."""
    return _known(df, keys).groupBy(*keys).agg(*(F.round(F.avg(m), places).alias(m) for m in metrics))


def weighted_mean_by(df: DataFrame, keys, metrics=METRICS, weight: str = "word_count", places: int = 4) -> DataFrame:
    """Means weighted by another column; a null value's weight does not count."""
    return _known(df, keys).groupBy(*keys).agg(*(F.round(F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight))), places).alias(m) for m in metrics))


def both_means_by(df: DataFrame, keys, metrics=METRICS, weight: str = "word_count", places: int = 4) -> DataFrame:
    """Unweighted and weighted means side by side, in one pass instead of a join of two."""
    plain = [F.round(F.avg(m), places).alias(f"{m}_mean") for m in metrics]
    heavy = [F.round(F.sum(F.col(m) * F.col(weight)) / F.sum(F.when(F.col(m).isNotNull(), F.col(weight))), places).alias(f"{m}_wavg") for m in metrics]
    return _known(df, keys).groupBy(*keys).agg(*plain, *heavy)


def by_topic(df: DataFrame, keys, topics, metrics=METRICS, places: int = 4) -> DataFrame:
    """keys, topic, n_paragraphs and means, over the rows flagged for each topic; topics without a column are left out.

    Flags are unpivoted once, so that all topics share one scan and one shuffle.
    """
    have = [t for t in topics if f"topic_{t}" in df.columns]
    flags = F.array(*(F.when(F.col(f"topic_{t}"), F.lit(t)) for t in have))
    long = df.select(*keys, *metrics, F.explode(F.array_compact(flags)).alias("topic"))
    return _known(long, keys).groupBy(*keys, "topic").agg(F.count(F.lit(1)).alias("n_paragraphs"), *(F.round(F.avg(m), places).alias(m) for m in metrics))


def stats_by(df: DataFrame, keys, columns, stats=("min", "mean", "max"), places: int = 3) -> DataFrame:
    """`<column>_<stat>` for each column and statistic; medians are exact, by ranges (quantiles.py)."""
    made = {"min": F.min, "mean": F.avg, "max": F.max, "std": F.stddev_samp, "sum": F.sum, "count": F.count}
    df = _known(df, keys)
    out = df.groupBy(*keys).agg(*(F.round(made[s](c).cast("double"), places).alias(f"{c}_{s}") for c in columns for s in stats if s != "median"), F.count(F.lit(1)).alias("rows of key"))
    for c in columns if "median" in stats else ():
        middle = exact_quantiles(df, c, [0.5], keys)
        out = out.join(middle.select(*keys, F.round("value", places).alias(f"{c}_median")), list(keys), "left")
    return out.select(*keys, *(f"{c}_{s}" for c in columns for s in stats))


def describe(df: DataFrame, column: str, places: int = 1) -> DataFrame:
    """count, mean, std, min, quartiles, max of one column, exact."""
    c = F.col(column)
    whole = df.agg(F.count(c).alias("count"), F.round(F.avg(c), places).alias("mean"), F.round(F.stddev_samp(c), places).alias("std"), F.round(F.min(c).cast("double"), places).alias("min"), F.round(F.max(c).cast("double"), places).alias("max"))
    shares = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quartiles = exact_quantiles(df, column, list(shares.values()))
    row = quartiles.agg(*(F.round(F.max(F.when(F.col("share") == s, F.col("value"))), places).alias(n) for n, s in shares.items()))
    return whole.crossJoin(row).select("count", "mean", "std", "min", *shares, "max")  # a row by a row


def ratio_of_sums(df: DataFrame, keys, reform: str = "reform_count", criticism: str = "crit_count", words: str = "word_count") -> DataFrame:
    """Summed counts and their ratios to summed words; null ratios where there are no words."""
    out = _known(df, keys).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in (reform, criticism, words)))
    w = F.when(F.col(words) > 0, F.col(words))
    return out.withColumns({"ReformScore": F.col(reform) / w, "CriticismScore": F.col(criticism) / w, "NetScore": F.col(reform) / w - F.col(criticism) / w})


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """bin (1 to bins, the last closed on the right), n: equal widths between the least and the greatest value."""
    ends = df.agg(F.min(column).cast("double").alias("low"), F.max(column).cast("double").alias("high"))
    v = F.col(column).cast("double")
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * bins).cast("int") + 1, F.lit(bins))).otherwise(1)
    return df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).select(place.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def bands(column: Column, edges=(30, 100, 200)) -> list[Column]:
    """Counts of values under the first edge, between edges, and from the last on."""
    out = [F.count_if(column < edges[0]).alias(f"under_{edges[0]}")]
    out += [F.count_if((column >= a) & (column < b)).alias(f"from_{a}_to_{b}") for a, b in zip(edges, edges[1:], strict=False)]
    return [*out, F.count_if(column >= edges[-1]).alias(f"from_{edges[-1]}")]


def mean_of_means(df: DataFrame, outer: str, inner: str, metric: str, places: int = 3) -> DataFrame:
    """The mean over inner groups' means, by outer group."""
    first = df.groupBy(outer, inner).agg(F.avg(metric).alias("m"))
    return first.groupBy(outer).agg(F.round(F.avg("m"), places).alias(metric))


def joined_text(df: DataFrame, keys, text: str, order) -> DataFrame:
    """Texts of a group in order, joined by blanks. A group's text is one row, as the pooled statistics ask for."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda s: s["_t"]), " ").alias(text))


def document_frequency(df: DataFrame, text: str, lexicons: dict) -> DataFrame:
    """lexicon, term, n_docs, pct: rows whose lower-cased text contains each term.

    All terms are searched in one walk; those found in a row are exploded and counted, so only hits are shuffled; terms without a
    hit are added back.
    """
    spark = df.sparkSession
    terms = spark.createDataFrame([(n, t) for n, ts in lexicons.items() for t in ts], "lexicon string, term string").distinct()
    distinct = sorted({t for ts in lexicons.values() for t in ts})
    # a null among each row's terms counts the rows, in the same pass
    hits = F.concat(F.coalesce(found_terms(F.lower(text), distinct), F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
    counts = df.select(F.explode(hits).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = counts.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    out = terms.join(counts.where("term is not null"), "term", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return out.select("lexicon", "term", n.alias("n_docs"), F.when(F.col("total") > 0, F.round(100 * n / F.col("total"), 2)).alias("pct"))


def correlations(df: DataFrame, columns, places: int = 6) -> DataFrame:
    """a, b, r: Pearson's correlation of every pair of columns, over rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    known = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b)))
    row = df.agg(*(F.round(known(a, b), places).alias(f"r{i}") for i, (a, b) in enumerate(pairs)))
    return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)))))
