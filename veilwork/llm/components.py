"""Connected components of a graph given by links, by alternating star contractions.

Each round joins every node to the least node near it: first all larger neighbours (large star), then all smaller ones (small
star). Chains halve, so rounds grow with the logarithm of the longest chain. Nothing but a count and a checksum of the links comes
to the driver. Joins are plain sort-merge joins on the node, whose large partitions Spark splits, so a hub may have any number of
links; each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm._common import cut


def _joined(near: DataFrame) -> DataFrame:
    """near(u, v) with m, the least of u and all its v."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root): for each node of a link the least node that it reaches; equal ends are allowed."""
    state = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _joined(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _joined(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        state = cut(small.filter("u <> v").distinct())
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if now == seen:
            break
        seen = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
