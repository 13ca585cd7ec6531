"""Tables cut from their lineage: written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where materialise() wrote a table, kept on the DataFrame that reads it.
_WRITTEN = "_factloom_written"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the one the cluster names in spark.checkpoint.dir.

    Only where driver and executors are one process may it be a temporary folder of this machine; elsewhere each
    executor would write to its own disk, so a cluster that names none is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        named = named or tempfile.mkdtemp(prefix="factloom-checkpoint-")
        context.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here and a lost executor costs nothing.

    The files stay until forget() is called with the returned table, or the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    setattr(read, _WRITTEN, path)
    return read


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() returned and that no later query reads."""
    for t in tables:
        if path := getattr(t, _WRITTEN, None):
            spark = t.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table inside a loop; Spark removes the files when nobody refers to them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
