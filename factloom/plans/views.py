"""The test tables seen as the domain's: line items as mentions of a parameter in three stages of a document set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.sources.tables import table

#: Stages in order: design, working documents, as built.
STAGES = ("PD", "RD", "ID")

MENTIONS_SQL = """
(select l_partkey as param, case l_returnflag when 'A' then 'PD' when 'N' then 'RD' else 'ID' end as stage,
        l_quantity as num, l_extendedprice as price, l_orderkey as file_id, l_linenumber as page, 1 - l_discount as confidence,
        'S' || cast(l_suppkey % 4 as varchar) as source, case l_linestatus when 'O' then 'CURRENT' else 'SUPERSEDED' end as role,
        l_tax > 0.075 as disputed, l_suppkey as supplier, l_shipdate as shipped
 from lineitem)
"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.when(F.col("l_returnflag") == "A", "PD").when(F.col("l_returnflag") == "N", "RD").otherwise("ID")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("param"),
        stage.alias("stage"),
        F.col("l_quantity").alias("num"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_orderkey").alias("file_id"),
        F.col("l_linenumber").alias("page"),
        (1 - F.col("l_discount")).alias("confidence"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 4).cast("string")).alias("source"),
        F.when(F.col("l_linestatus") == "O", "CURRENT").otherwise("SUPERSEDED").alias("role"),
        (F.col("l_tax") > 0.075).alias("disputed"),
        F.col("l_suppkey").alias("supplier"),
        F.col("l_shipdate").alias("shipped"),
    )
