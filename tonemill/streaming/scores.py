"""The narrow operators over a stream: files that arrive are cut, scored and summed up as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonemill.functions import scoring as S
from tonemill.operators import aggregate as A
from tonemill.operators import segment


def paragraph_stream(spark: SparkSession, folder: str, pattern: str = "*_raw.txt") -> DataFrame:
    """A stream of paragraphs of the report files that appear in a folder."""
    files = spark.readStream.option("pathGlobFilter", pattern).option("wholetext", True).text(folder)
    country, year = segment.parse_filename(F.col("_metadata.file_name"))
    docs = files.select(country.alias("country"), year.alias("year"), F.col("value").alias("text")).where("country is not null")
    return segment.build_corpus(docs)


def score_stream(paragraphs: DataFrame, hard, soft) -> DataFrame:
    """Paragraphs with both scores and their ratio."""
    t = F.col("paragraph_text")
    out = paragraphs.withColumns({"criticism_hard_p1k": S.dict_score(t, hard), "criticism_soft_p1k": S.dict_score(t, soft)})
    return out.withColumn("severity_ratio", S.severity(F.col("criticism_hard_p1k"), F.col("criticism_soft_p1k")))


def summary_stream(scored: DataFrame) -> DataFrame:
    return A.mean_by(scored, ("country", "year"))


def start_summary(scored: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """The running summary as a table in memory; state is kept in the checkpoint folder."""
    return summary_stream(scored).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
