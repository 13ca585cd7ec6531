"""Event operators as Structured Streaming queries: the same rows as their batch forms once all data is in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: How late an event may come.
LATENESS = "3 days"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream; a declared schema, since streams infer none."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def metric_buckets(events: DataFrame, width: str = "6 hours") -> DataFrame:
    """Tumbling buckets that close when the watermark passes them."""
    by = timed(events).withWatermark("ts", LATENESS).groupBy(F.window("ts", width), "event_type")
    rows = by.agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("n"))
    return rows.select(F.unix_timestamp("window.start").alias("bucket"), "event_type", "mean", "low", "high", "n")


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    """Activity sessions of users."""
    by = timed(events).withWatermark("ts", LATENESS).groupBy(F.session_window("ts", gap), "user_id")
    return by.agg(F.count("*").alias("events")).select("user_id", F.unix_timestamp("session_window.start").alias("start"), "events")


def idempotent(events: DataFrame, keys: list[str]) -> DataFrame:
    """Each event once, however often it is sent within the lateness."""
    return timed(events).withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(keys)


def current_status(events: DataFrame) -> DataFrame:
    """Status of each user by event time, updated as late events come."""

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, -1, "")
        for f in frames:
            stamp = f.ts.astype("int64") // 1000 if str(f.ts.dtype).startswith("datetime64[ns") else f.ts.astype("int64")
            best = max(best, max(zip(stamp.tolist(), f.event_id.tolist(), f.event_type.tolist())))
        state.update(best)
        yield pd.DataFrame({"user_id": [key[0]], "status": [best[2]], "at": [best[0]]})

    return timed(events).groupBy("user_id").applyInPandasWithState(
        latest, "user_id long, status string, at long", "at long, event_id long, status string", "update", GroupStateTimeout.NoTimeout
    )


def recompute_affected(changed: DataFrame, facts: Callable[[], DataFrame], evaluate: Callable[[DataFrame], DataFrame], key: str, write: Callable[[DataFrame, int], None]):
    """A writer that evaluates, for each micro-batch, only the keys its rows touch."""

    def each(batch: DataFrame, number: int) -> None:
        touched = batch.select(key).distinct()
        write(evaluate(facts().join(touched, key, "left_semi")), number)

    return changed.writeStream.foreachBatch(each)
