"""Statistics as aggregates and expressions; where two conventions exist both are kept apart by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.sources.shared import checkpointed


def nearest_rank(column: str, p: float) -> Column:
    """Percentile as an element of the data."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def ratio(a: Column, b: Column, undefined: float | None = None) -> Column:
    """a / b, or what the convention says where b is 0: 0, or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(undefined).cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share; null for no trials."""
    p, z2 = k / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n)
    low, high = (centre - half) / (1 + z2 / n), (centre + half) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def zero_error_bound(n: Column, confidence: float) -> Column:
    """Upper bound of the error rate after n trials without an error."""
    return 1 - F.pow(F.lit(1 - confidence), 1 / n)


def auc(rows: DataFrame, score: str, label: str, keys: list[str]) -> DataFrame:
    """Area under the ROC curve by average ranks, from counts of each score: ties share their rank.

    Counting by score first keeps the ranking window over distinct scores of a group rather than over its rows.
    """
    counted = rows.groupBy(*keys, score).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    scored = counted.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    total = scored.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return total.select(*keys, ratio(F.col("won"), F.col("p") * F.col("n")).alias("auc"))


def robust_model(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Median and scaled median absolute deviation of a value by key, with the number of values."""
    valued = rows.select(*keys, value.alias("_v")).where("_v is not null")
    centre = valued.groupBy(*keys).agg(F.expr("percentile(_v, 0.5)").alias("median"), F.count("*").alias("n"))
    spread = valued.join(centre, keys).groupBy(*keys).agg(
        F.first("median").alias("median"), F.first("n").alias("n"), (F.expr("percentile(abs(_v - median), 0.5)") * 1.4826).alias("mad")
    )
    return spread


def hash_share(key: Column) -> Column:
    """A number in [0, 1] from the first four digest bytes, unsigned."""
    first = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return first / F.lit(4294967295.0)


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """Rows of a table with a unique key numbered from 0 in its order: by range, the sizes of earlier ranges added."""
    dealt = checkpointed(df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_part").orderBy(key)) - 1
    return dealt.join(F.broadcast(before), "_part").withColumn(out, inside + F.col("_before")).drop("_part", "_before")


def bootstrap(objects: DataFrame, key: str, metrics: dict[str, tuple[str, str]], replicates: int, seed: str, level: float = 0.95, differences: list[tuple[str, str]] = ()) -> DataFrame:
    """metric, value, low, high and replicates: percentile intervals of ratios over resampled objects.

    Each replicate draws as many objects as there are, with replacement, by a hash of seed, replicate and draw; all
    metrics, (numerator, denominator) columns by name, and their ``differences`` see the same draws. Objects have sums
    already, so what is resampled is a row for each draw and not for each case. A replicate whose denominator is 0 has no
    value, nor has one of its differences.
    """
    n = objects.count()
    columns = sorted({c for pair in metrics.values() for c in pair})
    spark = objects.sparkSession
    draws = spark.range(replicates * n).select(F.floor(F.col("id") / F.lit(max(n, 1))).alias("_b"), (F.col("id") % F.lit(max(n, 1))).alias("_i"))
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "_b", "_i")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    counts = draws.groupBy("_b", F.floor(unit * n).alias("_at")).agg(F.count("*").alias("_times"))
    sums = counts.join(numbered(objects, key, "_at"), "_at").groupBy("_b").agg(*[F.sum(F.col("_times") * F.col(c)).alias(c) for c in columns])
    whole = objects.agg(*[F.sum(c).alias(c) for c in columns])
    ratio = {name: F.try_divide(F.col(x), F.col(y)) for name, (x, y) in metrics.items()}
    every = ratio | {f"{a} - {b}": ratio[a] - ratio[b] for a, b in differences}
    long = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), v.cast("double").alias("value")) for name, v in every.items()])).alias("m")).select("m.*")
    tail = (1 - level) / 2
    spread = long(sums).where("value is not null").groupBy("metric").agg(
        F.percentile("value", F.lit(tail)).alias("low"), F.percentile("value", F.lit(1 - tail)).alias("high"), F.count("*").alias("replicates")
    )
    return long(whole).join(spread, "metric", "left").select("metric", "value", "low", "high", F.coalesce("replicates", F.lit(0).cast("long")).alias("replicates"))
