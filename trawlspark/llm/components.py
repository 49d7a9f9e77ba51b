"""Connected components in DataFrame operations only: star contractions for any graph, pointer jumping for a forest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import cut


def _settled(edges: DataFrame) -> bool:
    """Every node has one edge to a smaller one at most, and then none from a larger one: the edges are separate stars."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 AND up > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges``, which has columns ``u`` and ``v`` of any one ordered type.

    ``component`` is the smallest node that can be reached. Self-loops and repeated edges are allowed, edges with a null
    end are dropped, no edges give no rows. Each round ties all larger neighbours of a node to its smallest one (large
    star), then all smaller ones (small star), until the edges are stars; rounds grow as the square of the logarithm of the longest path at most.
    A hub's neighbours are folded by partial minima and joined back, which adaptive execution can split.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _settled(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        tied = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(tied.union(small.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def roots(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (u, v), where each u is in one row only and v is less than u.

    ``component`` is the end of a node's way along the links, the smallest node of its tree. Each round doubles the steps
    that are taken, so rounds grow as the logarithm of the longest way; a round is one join.
    """
    ways = links.select("u", "v")
    while True:
        step = ways.select(F.col("u").alias("v"), F.col("v").alias("further"))
        jumped = cut(ways.join(step, "v", "left").select("u", F.coalesce("further", "v").alias("v"), F.col("further").isNotNull().alias("moved")))
        ways = jumped.select("u", "v")
        if jumped.where("moved").isEmpty():
            return ways.select(F.col("u").alias("node"), F.col("v").alias("component")).union(ways.select("v", "v").distinct())
