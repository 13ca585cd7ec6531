"""Parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.sources.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; projection and filters reach the scan through Catalyst."""
    ship(spark.sparkContext)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed value: rows of a key's share at most, on average, where a task's memory grows with its rows.
ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """Rows dealt out by key to as many tasks as their number asks for, so that a task's share doesn't grow with the table."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, -(-df.count() // rows)), *keys)
