"""Generated documents in the shape of reports: entity, year, text with paragraph marks; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill import session
from tonemill.functions import scoring as S
from tonemill.operators import segment


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. Texts that come in fewer splits than there are cores are dealt out first, since cutting and scoring are narrow; a
    large input has more splits and stays where it is."""
    df, cores = session.table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, country, year, text: each line end is a paragraph mark (two blanks before it)."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.col("source").alias("country"), (2019 + F.col("doc_id") % 7).cast("int").alias("year"), F.replace("text", F.lit("\n"), F.lit("  \n")).alias("text"))


def paragraphs(spark: SparkSession, sf_dir: str, min_words: int = segment.MIN_WORDS, max_words: int = segment.MAX_WORDS) -> DataFrame:
    return segment.build_corpus(reports(spark, sf_dir), "text", min_words, max_words)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with both criticism scores and their ratio, by the proxy lists."""
    out = paragraphs(spark, sf_dir)
    text = F.col("paragraph_text")
    out = out.withColumns({"hard_raw": S.raw_count(text, L.PROXY_HARD), "soft_raw": S.raw_count(text, L.PROXY_SOFT)})
    words = F.col("word_count")
    out = out.withColumns({"criticism_hard_p1k": S.per_thousand(F.col("hard_raw"), words), "criticism_soft_p1k": S.per_thousand(F.col("soft_raw"), words)})
    return out.withColumn("severity_ratio", S.severity(F.col("criticism_hard_p1k"), F.col("criticism_soft_p1k")))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored paragraphs with topic flags, by the proxy topics."""
    return scored(spark, sf_dir).withColumns(S.topic_flags(F.col("paragraph_text"), L.PROXY_TOPICS))


def words_sql(text: str) -> str:
    return rf"CAST(len(list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')) AS INTEGER)"


def count_sql(text: str, terms) -> str:
    return "(" + " + ".join(f"(length({text}) - length(replace({text}, '{t}', ''))) // {len(t)}" for t in terms) + ")"


def any_sql(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


REPORTS = "reports AS (SELECT doc_id, source AS country, CAST(2019 + doc_id % 7 AS INTEGER) AS year, text FROM documents WHERE text IS NOT NULL)"
LINES = rf"""lines AS (SELECT doc_id, country, year, i, p, {words_sql('p')} AS wc FROM (
  SELECT doc_id, country, year, unnest(range(len(c))) AS i, unnest(c) AS p FROM (
    SELECT doc_id, country, year, list_transform(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\n{{2,}}'), lambda x: trim(x)) AS c FROM reports)))"""
PARAS = f"""{REPORTS},
{LINES},
paras AS (SELECT doc_id, country, year, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS paragraph_id,
  p AS paragraph_text, wc AS word_count FROM lines WHERE wc >= {segment.MIN_WORDS})"""
SCORED = f"""{PARAS},
scored AS (SELECT *, CAST(hard_raw AS DOUBLE) / word_count * 1000 AS criticism_hard_p1k, CAST(soft_raw AS DOUBLE) / word_count * 1000 AS criticism_soft_p1k,
  CASE WHEN soft_raw > 0 THEN (CAST(hard_raw AS DOUBLE) / word_count * 1000) / (CAST(soft_raw AS DOUBLE) / word_count * 1000) END AS severity_ratio
  FROM (SELECT *, {count_sql('lower(paragraph_text)', L.PROXY_HARD)} AS hard_raw, {count_sql('lower(paragraph_text)', L.PROXY_SOFT)} AS soft_raw FROM paras))"""
FLAGS = ", ".join(f"{any_sql('lower(paragraph_text)', terms)} AS topic_{name}" for name, terms in L.PROXY_TOPICS.items())
TAGGED = f"{SCORED},\ntagged AS (SELECT *, {FLAGS} FROM scored)"
