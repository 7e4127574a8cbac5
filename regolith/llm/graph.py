"""Connected components by alternating stars, on edges that never leave Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regolith.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node of its component, for every node of `edges` (longs u, v).

    A round hangs every node's larger neighbours, then its smaller ones, on the smallest of its neighbourhood; the
    number of rounds grows with the logarithm of the longest path. Each round is two aggregations (a node of very
    many edges is summed up before the shuffle) and two equi-joins (which adaptive execution splits at such a node),
    and is written once. No edges give no rows."""
    edges = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct(), "edges")
    while True:
        both = edges.unionAll(edges.select("lo", "hi"))
        least = both.groupBy("hi").agg(F.least(F.col("hi"), F.min("lo")).alias("m"))
        large = both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("lo", "m"), F.struct(F.col("hi").alias("lo"), "m"))).alias("e"))
        small = small.select(F.col("e.lo").alias("hi"), F.col("e.m").alias("lo")).where("hi <> lo").distinct()
        last, edges = edges, stored(small, "edges")
        discard(edges.sparkSession, last)
        # done when every node hangs on one that hangs on none
        hung = edges.groupBy("hi").count()
        if not edges.join(hung.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count() and not hung.where("count > 1").limit(1).count():
            break
    labels = edges.select(F.col("hi").alias("node"), F.col("lo").alias("label"))
    return labels.unionAll(labels.select(F.col("label").alias("node"), "label").distinct())
