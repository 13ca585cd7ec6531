"""Results kept by the hash of what they were made from and the version of what made them.

A folder has ``data/run=<id>`` with the results of a run and ``published/<id>``, an empty file that says they are whole.
A run writes its data first and publishes them last, so one that died in between leaves data that nobody reads, and the
next run makes what is missing anew. Publishing creates one file, which file systems do as a whole or not at all. Two
runs at once may make the same result twice; the one of the smaller id is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH = "content_sha256"


class ResultCache:
    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, part: str) -> list[str]:
        files = self._files()
        return sorted(s.getPath().getName() for s in files.listStatus(self._path(part))) if files.exists(self._path(part)) else []

    def runs(self) -> list[str]:
        """Published runs."""
        return self._names("published")

    def published(self, schema: str) -> DataFrame:
        """Results of this version in all published runs: the hash, the schema's columns and run, one for each hash."""
        every = f"{HASH} string, version string, {schema}"
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], f"{every}, run string").drop("version")
        read = self.spark.read.schema(f"{every}, run string").option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/run={r}" for r in runs])
        own = read.where(F.col("version") == self.version).drop("version")
        first = F.row_number().over(W.partitionBy(HASH).orderBy("run"))
        return own.withColumn("_no", first).where("_no = 1").drop("_no")

    def publish(self, run: str) -> None:
        self._files().create(self._path("published", run), False).close()

    def add(self, content: DataFrame, column: str, schema: str, make: Callable[[DataFrame], DataFrame]) -> str:
        """Make and publish the results of contents that have none yet; returns the run's id.

        ``make`` gets (hash, column), a row for each content, and gives the hash and the schema's columns. A null content
        has no result.
        """
        run = uuid.uuid4().hex
        hashed = content.where(F.col(column).isNotNull()).select(F.sha2(F.col(column).cast("binary"), 256).alias(HASH), column)
        new = hashed.join(self.published(schema).select(HASH), HASH, "left_anti").groupBy(HASH).agg(F.first(column).alias(column))
        made = make(new).withColumn("version", F.lit(self.version))
        made.write.parquet(f"{self.folder}/data/run={run}")
        self.publish(run)
        return run

    def of(self, rows: DataFrame, column: str, schema: str) -> DataFrame:
        """The rows with the results of their contents and the run that made them; nulls where there is none."""
        return rows.withColumn(HASH, F.sha2(F.col(column).cast("binary"), 256)).join(self.published(schema), HASH, "left")

    def sweep(self) -> list[str]:
        """Delete the data of runs that were never published; not while a run is at work."""
        left = [n for n in self._names("data") if n.removeprefix("run=") not in self.runs()]
        for name in left:
            self._files().delete(self._path("data", name), True)
        return left
