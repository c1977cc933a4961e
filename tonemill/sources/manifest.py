"""A manifest of sources: one row a key with the status of its latest attempt, partitioned, merged so that a run can be repeated."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonemill.session import cut


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The manifest's rows; none if nothing was written yet."""
    none = spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(path).select(*none.columns)  # the reader puts the partition last
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return none


def latest(rows: DataFrame, keys, attempt: str = "attempt") -> DataFrame:
    """Of each key the row of the greatest attempt; among equal attempts the greatest of the other columns, so that the result is fixed."""
    others = [c for c in rows.columns if c not in (*keys, attempt)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(F.col(attempt), *(F.col(c) for c in others))).alias("r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"r.`{c}`").alias(c) for c in rows.columns))


def merge(rows: DataFrame, path: str, schema: str, keys, partition: str, attempt: str = "attempt") -> None:
    """Merges a run's rows into the manifest at path: latest attempts win, and only partitions of the run are read and written again.

    Merging the same rows again changes nothing. Keys must hold the partition column; rows of null partitions are one partition.
    """
    spark = rows.sparkSession
    names = spark.createDataFrame([], schema).columns
    rows = cut(latest(rows.select(*names), keys, attempt))
    touched = rows.select(F.col(partition).alias("of run")).distinct()
    old = read(spark, path, schema)
    old = old.join(F.broadcast(touched), old[partition].eqNullSafe(touched["of run"]), "left_semi")
    both = cut(latest(old.unionByName(rows), keys, attempt))  # read before its partitions are written anew
    both.repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
