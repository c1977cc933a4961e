"""The batch pipeline as one command: text files to paragraphs, scores, topics and summaries."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill import lexicons as L
from tonemill.functions import scoring as S
from tonemill.operators import aggregate as A
from tonemill.operators import segment
from tonemill.plans import tables
from tonemill.sources import readers, sinks

TOPICS = {"five": L.TOPICS_FIVE, "four": L.TOPICS_FOUR}


def score_corpus(paragraphs: DataFrame, hard=L.CRITICISM_HARD, soft=L.CRITICISM_SOFT) -> DataFrame:
    """Paragraphs with both criticism scores and their ratio."""
    t = F.col("paragraph_text")
    out = paragraphs.withColumns({"criticism_hard_p1k": S.dict_score(t, hard), "criticism_soft_p1k": S.dict_score(t, soft)})
    return out.withColumn("severity_ratio", S.severity(F.col("criticism_hard_p1k"), F.col("criticism_soft_p1k")))


def tag_topics(paragraphs: DataFrame, topics=L.TOPICS_FIVE) -> DataFrame:
    return paragraphs.withColumns(S.topic_flags(F.col("paragraph_text"), topics))


def run(spark: SparkSession, raw_dir: str, out_dir: str, min_words: int = segment.MIN_WORDS, max_words: int = segment.MAX_WORDS, topics: str = "five", form: str = "parquet", results: bool = False, base: str | None = None) -> dict[str, DataFrame]:
    """Writes paragraphs, scores, summary and topic_summary, and returns them as read back.

    Text is cut and scored in one narrow pass that is written once; all other tables but the last two read that. With results:
    regressions (against the entity `base`), odds ratios, fitted rates, sensitivity to paragraph bounds and topic weights too.
    """
    write = sinks.write_csv if form == "csv" else sinks.write_parquet
    scores = tag_topics(score_corpus(segment.build_corpus(readers.raw_reports(spark, raw_dir), "text", min_words, max_words)), TOPICS[topics])
    sinks.write_parquet(scores, f"{out_dir}/scores.parquet")
    scores = spark.read.parquet(f"{out_dir}/scores.parquet")
    made = {
        "paragraphs": scores.select("country", "year", "paragraph_id", "paragraph_text", "word_count"),
        "summary": A.mean_by(scores, ("country", "year")),
        "topic_summary": A.by_topic(scores, ("country", "year"), TOPICS[topics]),
    }
    if results:
        texts = readers.raw_reports(spark, raw_dir)
        made |= tables.regression_tables(scores, base) | {"sensitivity_preprocessing": tables.sensitivity(texts), "lda_topic_weights": tables.topic_weights(texts)}
    for name, df in made.items():
        write(df, f"{out_dir}/{name}.{form}")
    return {"scores": scores, **made}


def main(argv=None) -> None:
    p = argparse.ArgumentParser(description="Build, score and summarise a report corpus.")
    p.add_argument("--raw-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--min-words", type=int, default=segment.MIN_WORDS)
    p.add_argument("--max-words", type=int, default=segment.MAX_WORDS)
    p.add_argument("--topics", choices=sorted(TOPICS), default="five")
    p.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    p.add_argument("--results", action="store_true", help="also write regressions, odds ratios, fitted rates, sensitivity and topic weights")
    p.add_argument("--base", help="the entity that regressions compare with; by default the first")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("tonemill").getOrCreate()
    run(spark, a.raw_dir, a.out_dir, a.min_words, a.max_words, a.topics, a.format, a.results, a.base)


if __name__ == "__main__":
    main()
