"""Connected components of a graph that is too large for one machine: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.llm.common import cut


def stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v) with u > v; a node's edges are aggregated and joined, never collected.

    Large star: each node hands its larger neighbours to the least of its neighbourhood. Small star: each node hands its
    smaller neighbours, and itself, to the least of them. Both are a minimum for each node and a join with it.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) of every node that has an edge; edges (a, b) of longs in any direction.

    Loops, repeated edges and nulls are ignored; no edges give no rows. Each round is kept in the shared folder, and the
    rounds end once the edges stay the same. Every round before that lowers some node's parent, so there is an end, and
    the number of rounds grows with the logarithm of the longest path.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    was, before = state(now), None
    while was[0] and was != before:
        now = cut(stars(now))
        was, before = state(now), was
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
