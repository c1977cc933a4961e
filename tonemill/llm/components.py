"""Connected components by contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonemill.llm.common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that links reach from each id of an edge.

    Each round hooks every id to its smallest neighbour below it, follows those hooks to their roots by doubling,
    and contracts the edges; rounds grow with the logarithm of the number of ids. Loops, repeated edges and null ends
    are of no effect; an empty table gives an empty result. All state is in checkpointed tables.
    """
    high, low = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    now = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high, low).distinct())
    labels = now.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id", F.col("id").alias("component"))
    while not now.isEmpty():
        roots = cut(now.groupBy("a").agg(F.min("b").alias("root")))
        while True:
            up = roots.select(F.col("a").alias("root"), F.col("root").alias("upper"))
            jumped = cut(roots.join(up, "root", "left").select("a", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved")))
            roots = jumped.select("a", "root")
            if jumped.where("moved").isEmpty():
                break
        to = roots.select(F.col("a").alias("component"), F.col("root").alias("upper"))
        labels = cut(labels.join(to, "component", "left").select("id", F.coalesce("upper", "component").alias("component")))
        x = now.join(roots.withColumnRenamed("root", "ra"), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
        x = x.join(roots.select(F.col("a").alias("b"), F.col("root").alias("rb")), "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
        now = cut(x.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels.select("id", "component")
