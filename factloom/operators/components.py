"""Connected components by alternating stars over an edge table (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.shared import checkpointed


def _nearest(links: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, or the node itself if that is smaller."""
    return checkpointed(links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour.

    The minima are checkpointed, so both sides of the join are plain exchanges and Spark can split the
    partition of a node that has most of the edges.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    moved = both.where("v > u").join(_nearest(both), "u")
    return checkpointed(moved.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    nearest = _nearest(down)
    moved = down.join(nearest, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return checkpointed(moved.unionAll(nearest.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any comparable type to (node, root), root being the smallest node reachable.

    Loops (a = b) and repeated edges do nothing; nodes without an edge to another node aren't returned.
    An edge with a null end is left out. Rounds end when a pass changes nothing.
    """
    ends = (F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = checkpointed(edges.where("a is not null and b is not null and a <> b").select(*ends).distinct())
    before = _state(edges)
    while before[0]:
        edges = _small_star(_large_star(edges))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
