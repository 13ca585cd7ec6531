"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.shared import checkpointed, forget, materialise, shared_dir  # noqa: F401
from factloom.sources.shipping import ship
from factloom.sources.tables import table  # noqa: F401

#: Rows of whole texts handed to a Python worker at once, and their bytes: whichever is reached first ends a batch.
TEXT_ROWS_PER_BATCH, TEXT_BYTES_PER_BATCH = 256, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory, and let workers find this package.

    Spark reads these settings of the session when a plan runs, so they stay after it; a single text above the bytes is
    a batch of its own.
    """
    ship(spark.sparkContext)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS_PER_BATCH)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES_PER_BATCH)


def clean_text(column: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
