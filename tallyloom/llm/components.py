"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node it reaches) for the nodes of ``edges`` (a, b).

    Each step hangs neighbours on the smallest node in reach; the minimum per node is combined before the shuffle, and a
    node with very many neighbours is one side of a join that may be split.  Written after each step; the number of
    steps grows with the logarithm of the longest path.
    """
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    size, rows = None, now.count()
    while True:
        # Large star: a node hands its larger neighbours its smallest one.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), rows)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large, rows)
        # Small star: a node and its smaller neighbours all hang on the smallest.
        least_below = scratch.keep(large.groupBy("a").agg(F.min("b").alias("m")), rows)
        hung = large.join(least_below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = scratch.keep(hung.unionByName(least_below.select("a", F.col("m").alias("b"))).distinct(), rows)
        state = small.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        scratch.free(now, least, large, least_below)
        now = small
        if state == size:
            break
        size = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
