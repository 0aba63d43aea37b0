"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wellspan.llm.common import keep_table


def _least(pairs: DataFrame) -> DataFrame:
    """(a, m): the least neighbour of each a, or a itself; written, so that the join below deals both sides itself and can split a hub."""
    return keep_table(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.filter("b > a").join(_least(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = _least(edges)
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (a, b) edges that is not its component's least node.

    Edges shrink to stars around the least node of each component in a number of rounds that grows as the logarithm of the
    nodes; each round is written to the shared folder. A hub only meets its least neighbour, never all pairs of neighbours.
    """
    now = keep_table(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or found[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(found)
        wide = keep_table(_large_star(now).filter("a != b").distinct())
        now = keep_table(_small_star(wide).filter("a != b").distinct())
