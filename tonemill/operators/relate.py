"""Joins, windows, top-k and set operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonemill.operators.scan import scanned


def as_of(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, value: str, default=None) -> DataFrame:
    """left with the value of the last right row at or before its position, by key; default before the first.

    Both sides are put in one order and the last value is carried forward: one sort and no range join. A key with many rows
    spans several tasks. Null keys and positions are values like others, positions of null first; of right rows at one
    position any may be the last.
    """
    others = [c for c in left.columns if c not in (key, left_at)]
    a = left.select(key, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value), F.struct(*others, F.lit(1).alias("_one")).alias("_row"))
    b = right.select(key, F.col(right_at).cast(left.schema[left_at].dataType).alias("_at"), F.lit(0).alias("_side"), value, F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    out = scanned(a.unionByName(b), [key], ["_at", "_side"], last={"_last": value}).where("_side = 1")
    last = F.col("_last") if default is None else F.coalesce("_last", F.lit(default))
    return out.select(key, F.col("_at").alias(left_at), *(F.col(f"_row.{c}").alias(c) for c in others), last.alias(value))


def missing_cells(df: DataFrame, dims) -> DataFrame:
    """Combinations of the dimensions' values that have no row. The grid is as large as the product of distinct values."""
    grid = reduce(lambda x, y: x.crossJoin(y), (df.select(d).where(F.col(d).isNotNull()).distinct() for d in dims))
    return grid.join(df.select(*dims).distinct(), list(dims), "left_anti")


def task_grid(entities: DataFrame, entity: str, first: int, last: int, known: DataFrame, status: str = "status") -> DataFrame:
    """entity, year, status: every entity in every year, `missing` where nothing is known."""
    grid = entities.select(entity).distinct().select(entity, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.join(known.select(entity, "year", status), [entity, "year"], "left").withColumn(status, F.coalesce(status, F.lit("missing")))


def dense_years(df: DataFrame, entity: str, first: int, last: int) -> DataFrame:
    """A row for each entity and year, values null where there was none."""
    grid = df.select(entity).distinct().select(entity, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))
    return grid.join(df, [entity, "year"], "left")


def changes(df: DataFrame, key: str, order: str, columns) -> DataFrame:
    """Differences to the row before, by key; rows with any null difference are dropped."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, order, *((F.col(c) - F.lag(c).over(w)).alias(c) for c in columns)).dropna(subset=list(columns))


def top_per_group(df: DataFrame, keys, by: Column, tie, n: int, rank: str = "rank") -> DataFrame:
    """The n rows of a group with the greatest value, ranked from 1; ties by the tie columns, ascending."""
    w = Window.partitionBy(*keys).orderBy(by.desc_nulls_last(), *tie)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def largest_changes(df: DataFrame, key: str, order: str, columns, n: int = 3) -> DataFrame:
    """key, order, driver, change, rank: the n columns whose change is greatest in size."""
    long = changes(df, key, order, columns).select(key, order, F.inline(F.array(*(F.struct(F.lit(c).alias("driver"), F.col(c).cast("double").alias("change")) for c in columns))))
    return top_per_group(long, [key, order], F.abs("change"), ["driver"], n)


def peak(df: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """The row with the greatest value by key; the first by the tie column among equals."""
    others = [c for c in df.columns if c != key]
    best = df.where(F.col(by).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(by), -F.col(tie))).alias("_r"))
    return best.select(key, *(F.col(f"_r.{c}").alias(c) for c in others))


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """The rows of each key's greatest position."""
    return df.withColumn("_last", F.max(at).over(Window.partitionBy(key))).where(F.col(at) == F.col("_last")).drop("_last")


def in_all(df: DataFrame, group: str, item: str) -> DataFrame:
    """Items that every group has."""
    total = df.agg(F.count_distinct(group).alias("groups"))
    return df.groupBy(item).agg(F.count_distinct(group).alias("n")).crossJoin(F.broadcast(total)).where("n = groups").select(item)


def in_one(df: DataFrame, group: str, item: str) -> DataFrame:
    """Items that one group alone has, with that group."""
    return df.groupBy(item).agg(F.count_distinct(group).alias("n"), F.min(group).alias(group)).where("n = 1").select(group, item)


def complete_entities(df: DataFrame, entity: str, dim: str, n: int) -> DataFrame:
    """Entities that occur with at least n different values of a dimension."""
    return df.groupBy(entity).agg(F.count_distinct(dim).alias("n")).where(F.col("n") >= n).select(entity)


def outer_bind(tables: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One column per table, aligned on a key; null where a table lacks it."""
    parts = [t.select(key, F.col(value).alias(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts)


def anchors(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, position, href, label: the links of each page, in order."""
    pattern = r'(?is)<a\b[^>]*\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
    hrefs, labels = (F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(i)) for i in (1, 2))
    both = F.arrays_zip(hrefs.alias("href"), labels.alias("label"))
    out = pages.select(page_id, F.posexplode(both).alias("position", "link"))
    return out.select(page_id, "position", F.col("link.href").alias("href"), F.trim(F.regexp_replace("link.label", "<[^>]*>", "")).alias("label"))


def preferred_link(links: DataFrame, page_id: str, first: Column, second: Column) -> DataFrame:
    """page_id, href: the first link that meets the first condition, else the first that meets the second."""
    best = links.groupBy(page_id).agg(F.min_by("href", F.when(first, F.col("position"))).alias("_a"), F.min_by("href", F.when(second, F.col("position"))).alias("_b"))
    return best.select(page_id, F.coalesce("_a", "_b").alias("href")).where("href is not null")
