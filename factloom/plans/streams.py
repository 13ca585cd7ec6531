"""Streams run over all files at hand, their result read back as a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.sources.shared import shared_dir
from factloom.sources.tables import table
from factloom.streaming import events as streams


def _work_dir(spark):
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _run(spark, sf_dir, transform):
    """Process what is there in micro-batches, exactly once by checkpoint and file sink."""
    schema = table(spark, sf_dir, "events").schema
    work = _work_dir(spark)
    stream = transform(streams.source(spark, f"{sf_dir}/events.parquet*", schema))
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{work}/checkpoint").option("path", f"{work}/out").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


@query(
    "stream_buckets",
    """
    with m as (select max(ts) as newest from events)
    select cast(floor(epoch(ts) / 21600) * 21600 as bigint) as bucket, event_type, round(avg(value), 9) as mean, count(value) as n from events, m
    group by 1, 2 having floor(epoch(max(ts)) / 21600) * 21600 + 21600 <= epoch(any_value(newest)) - 3 * 86400
    """,
)
def stream_buckets(spark, sf_dir):
    """Tumbling buckets that the watermark has closed."""
    return _run(spark, sf_dir, streams.metric_buckets).select("bucket", "event_type", F.round("mean", 9).alias("mean"), "n")


@query("stream_idempotent", "select count(*) as n, count(distinct event_id) as events from events")
def stream_idempotent(spark, sf_dir):
    """Every event sent twice, taken once."""
    twice = lambda s: streams.idempotent(s.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy"), ["event_id"]).select("event_id")
    return _run(spark, sf_dir, twice).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("events"))
