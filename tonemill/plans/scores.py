"""Queries: scoring, topics and group aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill import sql
from tonemill.functions import scoring as S
from tonemill.functions import text as X
from tonemill.operators import aggregate as A
from tonemill.operators import quantiles as Q
from tonemill.operators import relate as R
from tonemill.operators import segment as G
from tonemill.plans.adapter import PARAS, REPORTS, SCORED, TAGGED, any_sql, count_sql, paragraphs, reports, scored, table, tagged, words_sql
from tonemill.plans.registry import query

M = "round(avg(criticism_hard_p1k), 4) AS criticism_hard_p1k, round(avg(criticism_soft_p1k), 4) AS criticism_soft_p1k, round(avg(severity_ratio), 4) AS severity_ratio"
KEYS = ("country", "year")


@query(f"WITH {SCORED} SELECT country, year, {M} FROM scored GROUP BY country, year")
def country_year_summary(spark, sf_dir):
    """The flagship: paragraphs, scores, unweighted means by entity and year."""
    return A.mean_by(scored(spark, sf_dir), KEYS)


_ARRAY = lambda terms: "array(" + ", ".join(f"'{t}'" for t in terms) + ")"


@query(f"WITH {SCORED} SELECT country, year, {M} FROM scored GROUP BY country, year")
def sql_country_year_summary(spark, sf_dir):
    """The flagship again, by the session's SQL functions: paragraphs by a lateral table function, scores by scalar ones."""
    sql.register(spark)
    scores = f"dict_score(p.paragraph_text, {_ARRAY(L.PROXY_HARD)}) AS hard, dict_score(p.paragraph_text, {_ARRAY(L.PROXY_SOFT)}) AS soft"
    means = "round(avg(hard), 4) AS criticism_hard_p1k, round(avg(soft), 4) AS criticism_soft_p1k, round(avg(severity(hard, soft)), 4) AS severity_ratio"
    return spark.sql(f"SELECT country, year, {means} FROM (SELECT d.country, d.year, {scores} FROM {{docs}} d, LATERAL build_corpus(d.text, 50, 500) p) GROUP BY country, year", docs=reports(spark, sf_dir))


@query(f"WITH {SCORED} SELECT doc_id, paragraph_id, hard_raw, soft_raw, round(criticism_hard_p1k, 8) AS criticism_hard_p1k, round(criticism_soft_p1k, 8) AS criticism_soft_p1k, round(severity_ratio, 8) AS severity_ratio FROM scored")
def paragraph_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "paragraph_id", "hard_raw", "soft_raw", *(F.round(m, 8).alias(m) for m in A.METRICS))


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, {count_sql('lower(paragraph_text)', L.CRITICISM_HARD)} AS hard, {count_sql('lower(paragraph_text)', L.CRITICISM_SOFT)} AS soft, {count_sql('lower(paragraph_text)', L.REFORM_HARD)} AS reform_hard, {count_sql('lower(paragraph_text)', L.REFORM_SOFT)} AS reform_soft FROM paras")
def full_lexicon_counts(spark, sf_dir):
    """The four fixed lists themselves; generated text holds few of their terms."""
    t = F.col("paragraph_text")
    lists = {"hard": L.CRITICISM_HARD, "soft": L.CRITICISM_SOFT, "reform_hard": L.REFORM_HARD, "reform_soft": L.REFORM_SOFT}
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_id", S.raw_counts(t, lists).alias("n")).select("doc_id", "paragraph_id", "n.*")


_P = lambda terms: f"CAST({count_sql('lower(paragraph_text)', terms)} AS DOUBLE) / word_count * 1000"


@query(f"WITH {PARAS} SELECT doc_id, paragraph_id, round({_P(L.PROXY_HARD)} + {_P(L.PROXY_SOFT)} - {_P(L.PROXY_REFORM_HARD)} - {_P(L.PROXY_REFORM_SOFT)}, 6) + 0.0 AS net FROM paras")
def net_criticism_scores(spark, sf_dir):
    net = S.net_criticism(F.col("paragraph_text"), L.PROXY_HARD, L.PROXY_SOFT, L.PROXY_REFORM_HARD, L.PROXY_REFORM_SOFT)
    return paragraphs(spark, sf_dir).select("doc_id", "paragraph_id", (F.round(net, 6) + F.lit(0.0)).alias("net"))


@query(f"WITH {TAGGED} SELECT doc_id, paragraph_id, {', '.join(f'topic_{t}' for t in L.PROXY_TOPICS)} FROM tagged")
def topic_tags(spark, sf_dir):
    return tagged(spark, sf_dir).select("doc_id", "paragraph_id", *(f"topic_{t}" for t in L.PROXY_TOPICS))


_FIXED = {**{f"five_{k}": v for k, v in L.TOPICS_FIVE.items()}, **{f"four_{k}": v for k, v in L.TOPICS_FOUR.items()}}


@query(f"WITH {PARAS} SELECT {', '.join(f'''count(*) FILTER ({any_sql('lower(paragraph_text)', v)}) AS {k}''' for k, v in _FIXED.items())} FROM paras")
def fixed_topic_totals(spark, sf_dir):
    """Paragraphs of each topic of both fixed families."""
    flags = paragraphs(spark, sf_dir).select(S.topic_flags_at_once(F.col("paragraph_text"), _FIXED).alias("flags"))
    return flags.agg(*(F.count_if(F.col(f"flags.topic_{k}")).alias(k) for k in _FIXED))


@query(f"WITH {TAGGED} " + " UNION ALL ".join(f"SELECT country, year, '{t}' AS topic, count(*) AS n_paragraphs, {M} FROM tagged WHERE topic_{t} GROUP BY country, year" for t in L.PROXY_TOPICS))
def country_year_topic(spark, sf_dir):
    return A.by_topic(tagged(spark, sf_dir), KEYS, L.PROXY_TOPICS)


_W = ", ".join(f"round(sum({m} * word_count) / sum(CASE WHEN {m} IS NOT NULL THEN word_count END), 4) AS {m}" for m in A.METRICS)


@query(f"WITH {SCORED} SELECT country, year, {_W} FROM scored GROUP BY country, year")
def weighted_summary(spark, sf_dir):
    return A.weighted_mean_by(scored(spark, sf_dir), KEYS)


@query(f"WITH {SCORED}, u AS (SELECT country, year, {M} FROM scored GROUP BY ALL), w AS (SELECT country, year, {_W} FROM scored GROUP BY ALL) SELECT country, year, {', '.join(f'u.{m} AS {m}_mean, w.{m} AS {m}_wavg' for m in A.METRICS)} FROM u JOIN w USING (country, year)")
def weighted_and_plain(spark, sf_dir):
    """The join of both means by entity and year, in one pass."""
    return A.both_means_by(scored(spark, sf_dir), KEYS)


@query(f"WITH {SCORED} SELECT country, year, {', '.join(f'round(min({m}), 3) AS {m}_min, round(avg({m}), 3) AS {m}_mean, round(max({m}), 3) AS {m}_max' for m in A.METRICS)} FROM scored GROUP BY country, year")
def metric_ranges(spark, sf_dir):
    return A.stats_by(scored(spark, sf_dir), KEYS, A.METRICS)


@query(f"WITH {PARAS} SELECT country, round(CAST(min(word_count) AS DOUBLE), 1) AS word_count_min, round(avg(word_count), 1) AS word_count_mean, round(median(word_count), 1) AS word_count_median, round(CAST(max(word_count) AS DOUBLE), 1) AS word_count_max, round(stddev_samp(word_count), 1) AS word_count_std FROM paras GROUP BY country")
def word_count_statistics(spark, sf_dir):
    return A.stats_by(paragraphs(spark, sf_dir), ["country"], ["word_count"], ("min", "mean", "median", "max", "std"), 1)


@query(f"WITH {PARAS} SELECT count(word_count) AS count, round(avg(word_count), 1) AS mean, round(stddev_samp(word_count), 1) AS std, round(CAST(min(word_count) AS DOUBLE), 1) AS min, round(quantile_cont(word_count, 0.25), 1) AS p25, round(quantile_cont(word_count, 0.5), 1) AS p50, round(quantile_cont(word_count, 0.75), 1) AS p75, round(CAST(max(word_count) AS DOUBLE), 1) AS max FROM paras")
def word_count_description(spark, sf_dir):
    return A.describe(paragraphs(spark, sf_dir), "word_count")


@query("SELECT event_type, share, round(CASE share WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.25 THEN quantile_cont(value, 0.25) WHEN 0.5 THEN quantile_cont(value, 0.5) WHEN 0.75 THEN quantile_cont(value, 0.75) ELSE quantile_cont(value, 0.999) END, 6) AS value FROM events, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.999])::DOUBLE AS share) WHERE value IS NOT NULL GROUP BY event_type, share")
def event_value_quantiles(spark, sf_dir):
    """Quantiles of a column of many values, by type."""
    out = Q.exact_quantiles(table(spark, sf_dir, "events"), "value", [0.1, 0.25, 0.5, 0.75, 0.999], ["event_type"])
    return out.withColumn("value", F.round("value", 6))


@query("SELECT count(o_totalprice) AS count, round(avg(o_totalprice), 1) AS mean, round(stddev_samp(o_totalprice), 1) AS std, round(CAST(min(o_totalprice) AS DOUBLE), 1) AS min, round(quantile_cont(o_totalprice, 0.25), 1) AS p25, round(quantile_cont(o_totalprice, 0.5), 1) AS p50, round(quantile_cont(o_totalprice, 0.75), 1) AS p75, round(CAST(max(o_totalprice) AS DOUBLE), 1) AS max FROM orders")
def order_price_description(spark, sf_dir):
    return A.describe(table(spark, sf_dir, "orders"), "o_totalprice")


_TOK = r"list_filter(string_split_regex(lower(regexp_replace(text, '[^\p{L}\p{N}\p{M}_\s]', '', 'g')), '\s+'), lambda w: w <> '')"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _token_scores(spark, sf_dir):
    docs = reports(spark, sf_dir).withColumn("tokens", X.words(X.drop_punctuation(F.col("text"))))
    return docs.select("country", "year", S.token_count(F.col("tokens"), L.PROXY_TOKENS[:3]).alias("reform_count"), S.token_count(F.col("tokens"), L.PROXY_TOKENS[3:]).alias("crit_count"), F.size("tokens").cast("long").alias("word_count"))


@query(rf"""WITH {REPORTS}, t AS (SELECT country, year, {_TOK} AS t FROM reports),
n AS (SELECT country, year, sum(len(list_filter(t, lambda w: list_contains({_LIST(L.PROXY_TOKENS[:3])}, w))))::BIGINT AS reform_count, sum(len(list_filter(t, lambda w: list_contains({_LIST(L.PROXY_TOKENS[3:])}, w))))::BIGINT AS crit_count, sum(len(t))::BIGINT AS word_count FROM t GROUP BY country, year)
SELECT country, year, reform_count, crit_count, word_count, round(reform_count / word_count, 9) AS "ReformScore", round(crit_count / word_count, 9) AS "CriticismScore", round(reform_count / word_count - crit_count / word_count, 9) AS "NetScore" FROM n""")
def token_ratio_summary(spark, sf_dir):
    """The exact-token scorer: summed counts and ratios of sums."""
    out = A.ratio_of_sums(_token_scores(spark, sf_dir), KEYS)
    return out.withColumns({c: F.round(c, 9) for c in ("ReformScore", "CriticismScore", "NetScore")})


@query(f"WITH {SCORED} SELECT CAST(sum(hard_raw) AS BIGINT) AS hard_raw, CAST(sum(soft_raw) AS BIGINT) AS soft_raw, CAST(sum(word_count) AS BIGINT) AS words, round(sum(hard_raw) / sum(word_count) * 1000, 4) AS hard_p1k, round(sum(soft_raw) / sum(word_count) * 1000, 4) AS soft_p1k, round(sum(hard_raw) / sum(soft_raw), 4) AS severity FROM scored")
def corpus_totals(spark, sf_dir):
    s = F.sum
    return scored(spark, sf_dir).agg(s("hard_raw").alias("hard_raw"), s("soft_raw").alias("soft_raw"), s("word_count").alias("words"), F.round(s("hard_raw") / s("word_count") * 1000, 4).alias("hard_p1k"), F.round(s("soft_raw") / s("word_count") * 1000, 4).alias("soft_p1k"), F.round(F.try_divide(s("hard_raw"), s("soft_raw")), 4).alias("severity"))


@query(f"WITH {SCORED} SELECT count(*) AS n, count(*) FILTER (hard_raw > 0) AS with_hard, count(*) FILTER (soft_raw > 0) AS with_soft, count(severity_ratio) AS with_ratio FROM scored")
def hit_counts(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hard_raw") > 0).alias("with_hard"), F.count_if(F.col("soft_raw") > 0).alias("with_soft"), F.count("severity_ratio").alias("with_ratio"))


_FL = [f"topic_{t}" for t in L.PROXY_TOPICS]
_SUM = " + ".join(f"CAST({c} AS INTEGER)" for c in _FL)


@query(f"WITH {TAGGED} SELECT {', '.join(f'count(*) FILTER ({c}) AS {c}' for c in _FL)}, count(*) FILTER ({' OR '.join(_FL)}) AS any_topic, count(*) FILTER (NOT ({' OR '.join(_FL)})) AS no_topic, round(avg({_SUM}), 6) AS mean_topics FROM tagged")
def topic_coverage(spark, sf_dir):
    df = tagged(spark, sf_dir)
    found = reduce(lambda a, b: a | b, (F.col(c) for c in _FL))
    number = reduce(lambda a, b: a + b, (F.col(c).cast("int") for c in _FL))
    return df.agg(*(F.count_if(F.col(c)).alias(c) for c in _FL), F.count_if(found).alias("any_topic"), F.count_if(~found).alias("no_topic"), F.round(F.avg(number), 6).alias("mean_topics"))


@query(f"WITH {TAGGED} SELECT country, CAST(hard_raw > 0 AS INTEGER) AS hard_flag, CAST(soft_raw > 0 AS INTEGER) AS soft_flag, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in _FL)}, year - median(year) OVER () AS year_c, doc_id, paragraph_id FROM tagged WHERE country IN ('src1', 'src2', 'src3')")
def regression_rows(spark, sf_dir):
    """0/1 flags, all topic columns as integers, and the year centred on its median over rows."""
    df = tagged(spark, sf_dir).where(F.col("country").isin("src1", "src2", "src3"))
    mid = df.agg(F.median("year").alias("mid"))
    topics = [c for c in df.columns if c.startswith("topic_")]
    return df.crossJoin(F.broadcast(mid)).select("country", (F.col("hard_raw") > 0).cast("int").alias("hard_flag"), (F.col("soft_raw") > 0).cast("int").alias("soft_flag"), *(F.col(c).cast("int").alias(c) for c in topics), (F.col("year") - F.col("mid")).alias("year_c"), "doc_id", "paragraph_id")


@query(f"WITH {SCORED} SELECT doc_id, paragraph_id, year - median(year) OVER () AS year_c FROM scored WHERE year >= 2023")
def recent_rows(spark, sf_dir):
    """A range of years, centred anew."""
    df = paragraphs(spark, sf_dir).where("year >= 2023")
    return df.crossJoin(F.broadcast(df.agg(F.median("year").alias("mid")))).select("doc_id", "paragraph_id", (F.col("year") - F.col("mid")).alias("year_c"))


@query(f"WITH {SCORED} SELECT doc_id, paragraph_id, word_count FROM scored WHERE country = 'src1' AND year = 2022 AND criticism_hard_p1k > 20 AND severity_ratio IS NOT NULL")
def filtered_rows(spark, sf_dir):
    return scored(spark, sf_dir).where((F.col("country") == "src1") & (F.col("year") == 2022) & (F.col("criticism_hard_p1k") > 20) & F.col("severity_ratio").isNotNull()).select("doc_id", "paragraph_id", "word_count")


@query(f"WITH {SCORED} SELECT doc_id, paragraph_id FROM scored WHERE country IN ('src1', 'src4') AND year <> 2020 AND NOT contains(paragraph_text, '.....') AND NOT contains(lower(paragraph_text), 'with the')")
def expression_filter(spark, sf_dir):
    """A predicate as text, with lists and excluded phrases."""
    return paragraphs(spark, sf_dir).where("country in ('src1', 'src4') and year <> 2020 and not contains(paragraph_text, '.....') and not contains(lower(paragraph_text), 'with the')").select("doc_id", "paragraph_id")


@query(f"WITH {PARAS} SELECT count(*) FILTER (word_count < 30) AS under_30, count(*) FILTER (word_count >= 30 AND word_count < 100) AS from_30_to_100, count(*) FILTER (word_count >= 100 AND word_count < 200) AS from_100_to_200, count(*) FILTER (word_count >= 200) AS from_200 FROM paras")
def length_bands(spark, sf_dir):
    return paragraphs(spark, sf_dir).agg(*A.bands(F.col("word_count")))


@query(f"WITH {PARAS}, e AS (SELECT min(word_count) AS lo, max(word_count) AS hi FROM paras) SELECT CAST(least(floor((word_count - lo) / (hi - lo) * 40) + 1, 40) AS INTEGER) AS bin, count(*) AS n FROM paras, e GROUP BY 1")
def length_histogram(spark, sf_dir):
    return A.histogram(paragraphs(spark, sf_dir), "word_count")


@query(f"WITH {PARAS} SELECT country, year, count(*) AS n FROM paras GROUP BY country, year")
def group_sizes(spark, sf_dir):
    return paragraphs(spark, sf_dir).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REPORTS} SELECT DISTINCT country FROM reports ORDER BY country")
def distinct_entities(spark, sf_dir):
    return reports(spark, sf_dir).select("country").distinct().orderBy("country")


@query(f"WITH {SCORED} SELECT country, round(avg(m), 3) AS criticism_hard_p1k FROM (SELECT country, year, avg(criticism_hard_p1k) AS m FROM scored GROUP BY country, year) GROUP BY country")
def mean_of_year_means(spark, sf_dir):
    return A.mean_of_means(scored(spark, sf_dir), "country", "year", "criticism_hard_p1k")


def _sensitivity(spark, sf_dir):
    """Entity means under three bounds of paragraph length, with the change against the first as text; texts are cut and scored once."""
    bounds = {"base": (50, 500), "short": (30, 500), "long": (80, 500)}
    p = G.sweep_corpus(reports(spark, sf_dir), bounds)
    p = p.select("country", "year", "bounds", S.dict_score(F.col("paragraph_text"), L.PROXY_HARD).alias("m"))
    means = p.select("country", "year", F.explode("bounds").alias("of"), "m").groupBy("country", "year", "of").agg(F.avg("m").alias("m")).groupBy("country", "of").agg(F.round(F.avg("m"), 3).alias("m"))
    out = means.groupBy("country").agg(*(F.max(F.when(F.col("of") == name, F.col("m"))).alias(name) for name in bounds))
    return out.select("country", "base", "short", "long", X.percent_change(F.col("short"), F.col("base")).alias("short_change"), X.percent_change(F.col("long"), F.col("base")).alias("long_change"))


_SENS = lambda low: f"(SELECT country, round(avg(m), 3) AS m FROM (SELECT country, year, avg(CAST({count_sql('lower(p)', L.PROXY_HARD)} AS DOUBLE) / wc * 1000) AS m FROM lines WHERE wc >= {low} GROUP BY country, year) GROUP BY country)"


@query(f"WITH {PARAS} SELECT country, b.m AS base, s.m AS short, l.m AS long, printf('%.1f%%', round(100 * (s.m - b.m) / b.m, 1)) AS short_change, printf('%.1f%%', round(100 * (l.m - b.m) / b.m, 1)) AS long_change FROM {_SENS(50)} b FULL JOIN {_SENS(30)} s USING (country) FULL JOIN {_SENS(80)} l USING (country)")
def sensitivity_table(spark, sf_dir):
    return _sensitivity(spark, sf_dir)


_LEX = {"hard": L.PROXY_HARD, "soft": L.PROXY_SOFT}


@query(f"WITH {PARAS}, n AS (SELECT count(*) AS total FROM paras) " + " UNION ALL ".join(f"SELECT '{k}' AS lexicon, '{t}' AS term, (SELECT count(*) FROM paras WHERE contains(lower(paragraph_text), '{t}')) AS n_docs, round(100 * (SELECT count(*) FROM paras WHERE contains(lower(paragraph_text), '{t}')) / total, 2) AS pct FROM n" for k, v in _LEX.items() for t in v))
def term_coverage(spark, sf_dir):
    """Paragraphs that contain each lexicon term."""
    return A.document_frequency(paragraphs(spark, sf_dir), "paragraph_text", _LEX)


@query(f"WITH {SCORED} SELECT a, b, round(r, 6) AS r FROM (SELECT 'hard' AS a, 'soft' AS b, corr(criticism_hard_p1k, criticism_soft_p1k) AS r FROM scored UNION ALL SELECT 'hard', 'words', corr(criticism_hard_p1k, word_count) FROM scored UNION ALL SELECT 'soft', 'words', corr(criticism_soft_p1k, word_count) FROM scored UNION ALL SELECT 'hard', 'hard', corr(criticism_hard_p1k, criticism_hard_p1k) FROM scored UNION ALL SELECT 'soft', 'soft', corr(criticism_soft_p1k, criticism_soft_p1k) FROM scored UNION ALL SELECT 'words', 'words', corr(word_count, word_count) FROM scored)")
def metric_correlations(spark, sf_dir):
    df = scored(spark, sf_dir).select(F.col("criticism_hard_p1k").alias("hard"), F.col("criticism_soft_p1k").alias("soft"), F.col("word_count").cast("double").alias("words"))
    return A.correlations(df, ["hard", "soft", "words"])


_PH = list(L.PROXY_SCALE)
_CN = ["n_" + p.replace(" ", "_") for p in _PH]


@query(f"WITH {REPORTS}, c AS (SELECT doc_id, {', '.join(f'''{count_sql('lower(text)', (p,))} AS {n}''' for p, n in zip(_PH, _CN, strict=True))} FROM reports), m AS (SELECT *, {' + '.join(_CN)} AS progress_mentions, {' + '.join(f'{n} * ({L.PROXY_SCALE[p]})' for p, n in zip(_PH, _CN, strict=True))} AS progress_score_raw FROM c) SELECT *, CASE WHEN progress_mentions > 0 THEN round(progress_score_raw / progress_mentions, 3) ELSE 0.0::DOUBLE END AS progress_score_norm FROM m")
def progress_scores(spark, sf_dir):
    """Phrase counts on a weighted scale; nested phrases count each."""
    got = S.progress(F.col("text"), L.PROXY_SCALE)
    return reports(spark, sf_dir).select("doc_id", *(c.alias("n_" + k.replace(" ", "_") if k in L.PROXY_SCALE else k) for k, c in got.items()))


@query(f"WITH {REPORTS}, c AS (SELECT country, year, {', '.join(f'''sum({count_sql('lower(text)', v)})::BIGINT AS {k}''' for k, v in L.PROXY_GROUPS.items())} FROM reports GROUP BY country, year) SELECT * FROM c")
def keyword_groups(spark, sf_dir):
    return reports(spark, sf_dir).groupBy(*KEYS).agg(*(F.sum(S.raw_count(F.col("text"), v)).alias(k) for k, v in L.PROXY_GROUPS.items()))


@query(f"""WITH {REPORTS}, c AS (SELECT country, year, {count_sql('lower(text)', ('the', 'of the', 'on the'))} AS p, {count_sql('lower(text)', ('that', 'with the', 'in'))} AS n FROM reports)
SELECT country, year, sum(p)::BIGINT AS positive, sum(n)::BIGINT AS negative, (sum(p) - sum(n))::BIGINT AS net FROM c GROUP BY country, year""")
def mention_balance(spark, sf_dir):
    """Positive, negative and net mentions."""
    t = F.col("text")
    df = reports(spark, sf_dir).groupBy(*KEYS).agg(F.sum(S.raw_count(t, ("the", "of the", "on the"))).alias("positive"), F.sum(S.raw_count(t, ("that", "with the", "in"))).alias("negative"))
    return df.withColumn("net", F.col("positive") - F.col("negative"))


@query(f"WITH {SCORED}, s AS (SELECT country, year, {M} FROM scored GROUP BY country, year) SELECT country, year, criticism_hard_p1k, (SELECT round(avg(criticism_hard_p1k), 4) FROM s) AS overall FROM s")
def summary_crosshair(spark, sf_dir):
    """Each group's mean beside the mean of all groups."""
    s = A.mean_by(scored(spark, sf_dir), KEYS)
    return s.crossJoin(F.broadcast(s.agg(F.round(F.avg("criticism_hard_p1k"), 4).alias("overall")))).select("country", "year", "criticism_hard_p1k", "overall")


@query(f"WITH {REPORTS} SELECT country FROM reports GROUP BY country HAVING count(DISTINCT year) >= 7")
def complete_entities(spark, sf_dir):
    return R.complete_entities(reports(spark, sf_dir), "country", "year", 7)


@query(f"WITH {SCORED} SELECT country, {', '.join(f'round(avg(CASE WHEN year = {y} THEN criticism_hard_p1k END), 4) AS y{y}' for y in range(2019, 2026))} FROM scored GROUP BY country")
def pivot_by_year(spark, sf_dir):
    df = scored(spark, sf_dir).groupBy("country").pivot("year", list(range(2019, 2026))).agg(F.round(F.avg("criticism_hard_p1k"), 4))
    return df.toDF("country", *(f"y{y}" for y in range(2019, 2026)))


@query(f"WITH {REPORTS} SELECT country, year, md5(string_agg(text, ' ' ORDER BY doc_id)) AS digest FROM reports GROUP BY country, year")
def pooled_text(spark, sf_dir):
    """Whole texts of a group joined in order, as a digest."""
    whole = reports(spark, sf_dir).withColumn("text", F.replace("text", F.lit("  \n"), F.lit("\n")))
    return A.joined_text(whole, KEYS, "text", ["doc_id"]).select(*KEYS, F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH {TAGGED} SELECT country, round(avg(CAST(hard_raw > 60 AS INTEGER)), 6) AS observed FROM tagged GROUP BY country")
def observed_rates(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("country").agg(F.round(F.avg((F.col("hard_raw") > 60).cast("int")), 6).alias("observed"))


@query("SELECT doc_id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, printf('%.1f%%', 100 * p) AS percent, regexp_extract('C(c, Treatment(''a''))[T.' || source || ']', '[TS]\\.(.+?)\\]', 1) AS level, printf('[%.3f, %.3f]', p - 1, p + 1) AS span, round(exp(p), 6) AS odds FROM (SELECT doc_id, source, CAST(doc_id % 97 AS DOUBLE) / 1000 AS p FROM documents)")
def table_formats(spark, sf_dir):
    """Significance marks, percentages, level names, intervals and odds ratios."""
    p = (F.col("doc_id") % 97).cast("double") / 1000
    name = F.concat(F.lit("C(c, Treatment('a'))[T."), "source", F.lit("]"))
    return table(spark, sf_dir, "documents").select("doc_id", X.stars(p).alias("stars"), X.percent(p).alias("percent"), X.level_name(name).alias("level"), X.interval(p - 1, p + 1).alias("span"), F.round(F.exp(p), 6).alias("odds"))


@query(f"SELECT doc_id, {words_sql('text')} AS words, upper(source) AS head, starts_with(text, 'T') AS starts, length(text) AS chars, regexp_replace(regexp_extract(text, '^[A-Z][a-z]*', 0), '^(.)', '\\1.') AS initial, regexp_replace('12. ' || source, '^\\d+\\.?\\s*', '') AS bare, lower(source) || '_s-e-fi' AS slugged FROM documents WHERE text IS NOT NULL")
def string_functions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    t = F.col("text")
    return d.select("doc_id", X.word_count(t).alias("words"), F.upper("source").alias("head"), t.startswith("T").alias("starts"), F.length(t).cast("long").alias("chars"), F.regexp_replace(F.regexp_extract(t, "^[A-Z][a-z]*", 0), "^(.)", "$1.").alias("initial"), X.drop_leading_number(F.concat(F.lit("12. "), "source")).alias("bare"), X.slugify(F.concat(F.lit(" "), "source", F.lit("_Š  é! - ﬁđ "))).alias("slugged"))
