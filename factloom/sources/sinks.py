"""Sinks that may run twice: overwrite by key, upsert, insert what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.picks import first_per


def publish(rows: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of the keys at hand and leave the others: a rerun publishes the same."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The table with new rows in place of old ones of the same key; among new ones the newest wins."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return first_per(both, keys, [F.desc("_new"), F.desc_nulls_last(newest)]).drop("_new")


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the table doesn't have, one for each key."""
    return rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")


def inserted_counts(table: DataFrame, rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How many rows an insert of what is new would add, by group."""
    return insert_new(table, rows, keys).groupBy(*by).agg(F.count("*").alias("inserted"))


def export_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def export_xml(rows: DataFrame, path: str, row_tag: str = "check", root_tag: str = "protocol") -> None:
    rows.write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


def validated(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows of JSON text with the parsed value and whether it has the schema's form."""
    parsed = F.from_json(F.col(column), f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    rows = texts.withColumn("parsed", parsed).withColumn("valid", F.col("parsed").isNotNull() & F.col("parsed._broken").isNull())
    return rows.withColumn("parsed", F.col("parsed").dropFields("_broken"))
