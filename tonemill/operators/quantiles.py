"""Exact quantiles by refining ranges: a few passes of counts, no task that holds all values of a column or key."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonemill.session import cut, maybe_broadcast, share_package

#: Equal parts that a range is cut into in each pass.
PARTS = 4096


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles (both zeros equal), so that ranges shrink alike whatever the magnitudes."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(2**63 - 1))


def of_bits(bits: np.ndarray) -> np.ndarray:
    return (bits ^ ((bits >> np.int64(63)) & np.int64(2**63 - 1))).view(np.float64)


def exact_quantiles(df: DataFrame, column: str, shares, keys=(), parts: int = PARTS) -> DataFrame:
    """keys, share, value: the quantiles of a column at the given shares (0 to 1), linear between neighbours.

    The value of a rank is sought in a range that holds it, at first from the least to the greatest value. A pass cuts each range
    into equal parts (of the doubles' order), counts by part (partial sums, so a large key is counted in all tasks) and goes on
    with the part that has the rank, from its least to its greatest value, until these are equal: after six passes at most with
    4,096 parts. Null and NaN values do not count; infinite ones do; keys without a value have no rows; null keys are keys.
    """
    share_package(df.sparkSession)
    v = F.col(column).cast("double")

    def to_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(ordered_bits(batch.column(1).to_numpy()))], ["k", "v"])

    given = df.where(v.isNotNull() & ~F.isnan(v)).select(F.struct(*(F.col(k) for k in keys), F.lit(1).alias("one of all")).alias("k"), v.alias("v"))
    rows = cut(given.mapInArrow(to_bits, T.StructType([given.schema["k"], T.StructField("v", T.LongType())])))
    wanted = F.explode(F.array(*(F.lit(float(s)) for s in shares)))
    sizes = cut(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    asked = sizes.select("k", "n", "low", "high", wanted.alias("share")).withColumn("at", F.col("share") * (F.col("n") - 1))
    found = asked.select("k", "low", "high", F.lit(0).cast("long").alias("under"), F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    done, todo = [], cut(found)
    while True:
        done.append(todo.where("low = high").select("k", "rank", F.col("low").alias("value")))
        todo = todo.where("low < high")
        if todo.isEmpty():
            break
        ranges = maybe_broadcast(cut(todo.select("k", "low", "high", "under").distinct()))
        met = rows.join(ranges, "k").where("v >= low and v <= high")
        # halves, so that no difference is beyond a long; both ends are parts of their own, so that every pass goes on
        inner = F.expr(f"(shiftright(v, 1) - shiftright(low, 1)) div ((shiftright(high, 1) - shiftright(low, 1)) div {parts} + 1)")
        part = F.when(F.col("v") == F.col("low"), -1).when(F.col("v") == F.col("high"), parts).otherwise(inner)
        counted = met.groupBy("k", F.col("low").alias("of"), part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.min("under").alias("under"))
        order = Window.partitionBy("k", "of").orderBy("part")  # as many rows as parts at most
        counted = counted.withColumn("under", F.col("under") + F.sum("n").over(order) - F.col("n"))
        ranks = todo.select("k", F.col("low").alias("of"), "rank")
        todo = cut(ranks.join(counted, ["k", "of"]).where((F.col("rank") >= F.col("under")) & (F.col("rank") < F.col("under") + F.col("n"))).select("k", "low", "high", "under", "rank"))

    @F.arrow_udf("double")
    def to_double(bits: pa.Array) -> pa.Array:
        return pa.array(of_bits(bits.to_numpy()))

    values = cut(reduce(DataFrame.unionByName, done).withColumn("value", to_double("value")))
    out = asked.select("k", "share", "at", F.floor("at").alias("rank")).join(values, ["k", "rank"]).withColumnRenamed("value", "a")
    out = out.withColumn("rank", F.ceil("at")).join(values.withColumnRenamed("value", "b"), ["k", "rank"])
    between = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at")))
    return out.select(*(F.col(f"k.`{name}`").alias(name) for name in keys), "share", between.alias("value"))
