"""Time series: tumbling buckets, counters that reset, activity with idle gaps, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def seconds(ts: str | Column = "ts") -> Column:
    """Seconds since the epoch, as a double, of a timestamp with or without a zone (taken as UTC)."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(column.cast("timestamp")) / 1e6


def bucket(ts: str, width: int) -> Column:
    """Start of the tumbling bucket in seconds."""
    return (F.floor(seconds(ts) / width) * width).cast("long")


def auto_width(span: int) -> int:
    """A width in seconds that gives a chart some 120 points."""
    for width in (60, 300, 900, 3600, 21600, 86400):
        if span / width <= 120:
            return width
    return 604800


def aggregate(rows: DataFrame, width: int, tags: list[str], value: str = "value") -> DataFrame:
    return rows.groupBy(bucket("ts", width).alias("bucket"), *tags).agg(
        F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(value).alias("n")
    )


def counter_delta(current: Column, previous: Column) -> Column:
    """Growth of a counter; one that went down was reset and counts from zero."""
    return F.when(previous.isNull() | (current < previous), current).otherwise(current - previous)


def active_seconds(rows: DataFrame, keys: list[str], idle: int) -> DataFrame:
    """Sum of the gaps between a key's events that aren't longer than the idle limit."""
    gap = seconds("ts") - F.lag(seconds("ts")).over(W.partitionBy(*keys).orderBy("ts", "event_id"))
    return rows.withColumn("_gap", gap).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("_gap") <= idle, F.col("_gap"))), F.lit(0.0)).alias("active"), F.count("*").alias("events")
    )


def histogram(rows: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets (le) of a histogram, also empty ones, the last without a bound."""
    cells = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    wide = rows.groupBy(*keys).agg(*cells, F.count(value).alias("le_inf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("le_inf").alias("n")))
    return wide.select(*keys, F.inline(F.array(*pairs)))
