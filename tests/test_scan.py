"""Scans over range partitions, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tonemill.operators import relate
from tonemill.operators.scan import scanned


def plain(rows):
    """row -> (last, before, total, number), rows being (key, at, value, n) in order."""
    out, last, before, total, number = {}, {}, {}, {}, {}
    for key, at, value, n in rows:
        was = before.get(key)
        last[key] = value if value is not None else last.get(key)
        before[key], total[key], number[key] = value, total.get(key, 0) + (n or 0), number.get(key, 0) + 1
        out[key, at] = (last[key], was, total[key], number[key])
    return out


def none_first(row):
    return (row[0] is not None, row[0] or 0, row[1])


@pytest.mark.parametrize("keys", [1, 3, 400])
def test_scans_equal_plain_python(spark, keys):
    rng = random.Random(keys)
    rows = [(rng.choice([None, *range(keys)]), i, rng.choice([None, f"v{i}"]), rng.choice([None, i % 11])) for i in range(2000)]
    df = spark.createDataFrame(rows, "key long, at int, value string, n int").repartition(5)
    got = scanned(df, ["key"], ["at"], last={"l": "value"}, before={"b": "value"}, sums={"s": "n"}, number="i")
    assert {(r.key, r.at): (r.l, r.b, r.s, r.i) for r in got.collect()} == plain(sorted(rows, key=none_first))
    whole = scanned(df, [], ["at"], sums={"s": "n"}, number="i").collect()
    assert [(r.s, r.i) for r in sorted(whole, key=lambda r: r.at)] == [v[2:] for v in plain((0, *r[1:]) for r in rows).values()]


def test_batches_hand_on(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(500).select((F.col("id") >= 450).cast("int").alias("key"), "id", F.when(F.col("id") % 90 == 5, F.col("id")).alias("v"))
        got = {r.id: (r.l, r.i) for r in scanned(df, ["key"], ["id"], last={"l": "v"}, number="i").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[449] == (365, 450) and got[450] == (None, 1) and got[499] == (455, 50)


def test_a_large_key_is_in_many_tasks(spark):
    """Half of all rows have one key; no task has more than a share of them."""
    left = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("user"), F.col("id").alias("at"), F.col("id").alias("event"))
    right = left.where("event % 10 = 0").select("user", "at", F.col("event").alias("found"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = relate.as_of(left, right, "user", "at", "at", "found")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in out.where("user = 0").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 8000
    assert out.where("user = 0 and found <> at - at % 10").count() == 0


def test_edges(spark):
    none = spark.createDataFrame([], "key long, at int, v array<int>")
    got = scanned(none, ["key"], ["at"], last={"l": "v"}, number="i")
    assert got.collect() == [] and got.columns == ["key", "at", "v", "l", "i"]
    left = spark.createDataFrame([(None, 1, "a"), (None, None, "b"), (1, 1, "c"), (1, 1, "c")], "key long, at int, _last string")
    right = spark.createDataFrame([(None, 1, 7), (1, 0, 8), (1, 0, 8), (1, 1, None)], "key long, at int, v int")
    got = relate.as_of(left, right, "key", "at", "at", "v", 0).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([(None, 1, "a", 7), (None, None, "b", 0), (1, 1, "c", 8), (1, 1, "c", 8)], "key long, at int, _last string, v int").collect()))
