"""Hypotheses from rules, and what happens to them afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.picks import first_per
from factloom.sources.shared import checkpointed

#: Longest deduplication key in bytes.
KEY_BYTES = 512


def bounded_key(key: Column, limit: int = KEY_BYTES) -> Column:
    """The key itself, or a prefix and its digest where it is too long in bytes."""
    digest = F.sha2(key.cast("binary"), 256)
    return F.when(F.octet_length(key) <= limit, key).otherwise(F.concat(F.left(key, F.lit((limit - 65) // 4)), F.lit(":"), digest))


def dedupe(hypotheses: DataFrame) -> DataFrame:
    """One hypothesis per key: the most confident, then the one raised first."""
    return first_per(hypotheses, ["dedup_key"], [F.desc("confidence"), F.asc("ordinal")])


def effective(start: Column, stop: Column, at: Column) -> Column:
    """A closed interval whose missing ends are open."""
    return (start.isNull() | (start <= at)) & (stop.isNull() | (at <= stop))


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor) over edges (child, parent), along paths of any length; a node of a cycle is its own ancestor.

    Each round follows the pairs that the last one found by one more edge, until none is new.
    """
    edges = checkpointed(edges.select("child", "parent").distinct())
    known = front = edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"))
    while True:
        step = front.join(edges, front.ancestor == edges.child).select("node", F.col("parent").alias("ancestor")).distinct()
        front = checkpointed(step.join(known, ["node", "ancestor"], "left_anti"))
        if front.isEmpty():
            return known
        known = checkpointed(known.unionByName(front))
