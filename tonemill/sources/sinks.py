"""Sinks: Parquet by default, CSV with a header, text partitioned by key."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by=()) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, columns=None) -> None:
    """CSV with a header and doubled quotes; arrays must be turned to text before."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_text(df: DataFrame, path: str, text: str = "text", keys=("country", "year")) -> None:
    """One folder per key, texts as lines."""
    df.select(*keys, text).write.mode("overwrite").partitionBy(*keys).text(path)
