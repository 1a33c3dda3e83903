"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop, materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component for every node of edges (a, b): component is the least node that it reaches. Every step groups
    with partial aggregates and joins on the node; a hub's rows are split by AQE's skew join. Rounds end when the edges
    no longer change, after about the logarithm of the longest path."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{name}-edges")
    state = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    mark = state(now)  # stars from the start are done after one round
    while True:
        # large star: every larger neighbour of a node meets the least of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour of a node, and the node, meet the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = materialize(small, f"{name}-edges")
        drop(now)
        now = after
        seen = state(now)
        if seen == mark:
            break
        mark = seen
    # all edges are now stars around the least node
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
