"""Connected components by alternating large-star and small-star steps, DataFrame only.

Every step is a few shuffles of narrow rows; stars of any size are joined, not gathered, so AQE can split
a hub.  Rounds grow with the logarithm of the size; each is checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sized


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``links`` (undirected) to rows (node, comp), comp the smallest node reachable; linked nodes only."""
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    mark = _mark(edges)
    while mark[0]:
        n = 2 * mark[0]  # a step has at most as many rows as both directions of the edges
        both = sized(edges, n).union(sized(edges, n).select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = sized(sized(large, n).distinct(), n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = cut(sized(sized(small.where("u <> v"), n).distinct(), n))
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
