"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sigloom.llm.common import stored


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    joined = both.join(_least_neighbour(both), "u").where("v > u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour, and the node itself, moves to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.where("u <> v").union(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge.

    ``edges`` has long columns u and v; a null in either and an edge from a node to itself link nothing, repeated edges
    and edges in both directions count once, and no edges give an empty result.  Rounds grow with the logarithm of the longest
    path; each round is a stored table, so a lost executor costs one round.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        size = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000000007)).first()
        if size[0] == 0 or size == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v"))).distinct()
        mark = size
        now = stored(small_star(large_star(now)), "edges")
