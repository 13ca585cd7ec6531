"""Ranking picks: one row per key by a total order, in place of DISTINCT ON and lateral top-1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key; the order must be total for a stable pick."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def source_rank(source: Column, ranked: list[str]) -> Column:
    """Place of a source in the list of preferred ones; after all of them if it is none, or at ``*``."""
    place = F.array_position(F.array(*map(F.lit, ranked)), source)
    other = ranked.index("*") if "*" in ranked else len(ranked)
    return F.when(place > 0, place - 1).otherwise(F.lit(other)).cast("int")


def tier_filter(df: DataFrame, keys: list[str], tier: Column) -> DataFrame:
    """Rows of the best tier that a key has: the first round that finds anything wins."""
    best = F.min(tier).over(W.partitionBy(*keys))
    return df.withColumn("_tier", tier).withColumn("_best", best).where("_tier = _best").drop("_tier", "_best")


def whole_groups(df: DataFrame, keys: list[str], group: str, order: list[Column]) -> DataFrame:
    """All rows of the one group of each key that comes first: a document is chosen whole."""
    rows = df.withColumn("_rows", F.count("*").over(W.partitionBy(*keys, group)))
    place = F.dense_rank().over(W.partitionBy(*keys).orderBy(*order, F.desc("_rows"), group))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place", "_rows")


def running_offset(df: DataFrame, keys: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """Sum of the sizes before each row; null after an unknown size, since later offsets can't be known."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    unknown = F.coalesce(F.sum(F.col(size).isNull().cast("int")).over(before), F.lit(0))
    return df.withColumn(out, F.when(unknown == 0, F.coalesce(F.sum(size).over(before), F.lit(0))))


def islands(df: DataFrame, keys: list[str], order: list[str], changed: Column, out: str) -> DataFrame:
    """Number the runs of rows between changes."""
    over = W.partitionBy(*keys).orderBy(*order)
    step = F.coalesce(changed.cast("int"), F.lit(0))
    return df.withColumn("_step", step).withColumn(out, F.sum("_step").over(over)).drop("_step")
