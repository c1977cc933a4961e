"""Corpus pipeline: quality filter, exact and near deduplication, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that it is given and returns a DataFrame; all but the last return
the columns of documents. A driver may write each stage's rows as Parquet and give the next stage what it reads back.

Of all stages: null and empty texts are texts like others (scored, equal to each other, without shingles, clean, one end token);
null ids are filtered like others, by their texts; whole texts count, however long; of rows equal in id and text one stays from
the second stage on; other columns, whatever their names, are passed on as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonemill.llm import decontamination, exact_dedup, ngram_jaccard, packing, quality
from tonemill.llm.common import stored, table

#: Packing places pieces by a least-squares fit over all rows; SQL cannot state the neighbour vote or that fit.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of equal texts."""
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each component of similar shingle sets."""
    return ngram_jaccard.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak benchmark items."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' token ids into windows."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
