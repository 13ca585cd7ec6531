"""Kinds over numbers: quantities within tolerances and norms, and counts of things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.kinds.registry import kind
from factloom.kinds.shared import CA, CL, KEYS, ME, NA, NC, NV, STAGES, earliest, has, is_later, n_stages, of, picked, subjects, true, wide
from factloom.operators.compare import SLACK, ladder


def _side_breach(value: Column, base: Column) -> Column:
    """By the param's direction and the larger of its absolute and relative tolerances; one on the border is none."""
    tolerance = F.greatest(F.coalesce("tolerance_abs", F.lit(0.0)), F.abs(base) * F.coalesce("tolerance_pct", F.lit(0.0)) / 100)
    delta = value - base
    return F.when(F.col("direction") == "decrease", -delta > tolerance + SLACK).when(F.col("direction") == "increase", delta > tolerance + SLACK).otherwise(F.abs(delta) > tolerance + SLACK)


def _variants(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Keep the mentions of the variant that an object's stages share; variant_conflict where they name some and share none."""
    named = rows.where(F.col("variant").isNotNull()).groupBy(*KEYS, "variant")
    stages = named.agg(F.countDistinct("stage").alias("n"), F.min("page").alias("page"))
    best = stages.groupBy(*KEYS).agg(F.max("n").alias("shared"), F.min_by("variant", F.struct(-F.col("n"), "page", "variant")).alias("chosen"))
    several = rows.where(F.col("variant").isNotNull()).groupBy(*KEYS).agg(F.countDistinct("stage").alias("named_stages"))
    best = best.join(several, KEYS).withColumn("variant_conflict", (F.col("named_stages") >= 2) & (F.col("shared") < 2))
    return rows.join(best.select(*KEYS, "chosen", "variant_conflict"), KEYS, "left")


@kind("quantity")
def quantity(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, norms: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Findings for quantities; mentions may name a variant and an element of the object they count for.

    Params have direction (decrease, increase, any), tolerance_abs, tolerance_pct and factors: ratios of stages near one
    of them are another unit and no change. Norms (param_code, side min or max, bound, severity fail or warn) are held
    against every mention; only failed ones make a candidate. Values without a number have lost their unit. Where every
    value names an element and one element is in two stages, each element is judged and the worst counts.
    """
    rows = _variants(of(mentions, params), params)
    rows = rows.where(F.col("variant").isNull() | F.coalesce(F.col("variant") == F.col("chosen"), F.lit(True)) | F.col("variant_conflict"))
    live = rows.where(F.col("value_num").isNotNull())
    shared = live.where(F.col("element").isNotNull()).groupBy(*KEYS, "element").agg((F.countDistinct("stage") > 1).alias("twice"))
    shared = shared.groupBy(*KEYS).agg(F.bool_or("twice").alias("twice"))
    whole = live.groupBy(*KEYS).agg(F.bool_and(F.col("element").isNotNull()).alias("all_named"))
    grouped = shared.join(whole, KEYS).select(*KEYS, (F.col("twice") & F.col("all_named")).alias("by_element"))
    rows = rows.join(grouped, KEYS, "left").withColumn("part", F.when(F.col("by_element"), F.col("element")).otherwise(F.lit("")))
    rows = rows.withColumn("part", F.coalesce("part", F.lit("")))
    parts = [*KEYS, "part"]
    chosen = rows.where(F.col("value_num").isNotNull())
    order = F.row_number().over(_per_stage(parts))
    chosen = chosen.where(F.col("stage").isin(*STAGES)).withColumn("_n", order).where("_n = 1")
    stages = wide(chosen, "value_num", keys=parts)
    spread = live.join(grouped, KEYS, "left").where(~F.coalesce("by_element", F.lit(False)) & F.col("element").isNotNull()).groupBy(*KEYS, "stage")
    spread = spread.agg((F.countDistinct("element") > 1).alias("many"), (F.countDistinct("value_num") > 1).alias("differ")).groupBy(*KEYS)
    spread = spread.agg(F.bool_or(F.col("many") & F.col("differ")).alias("spread"))
    flags = rows.groupBy(*KEYS).agg(F.bool_or(F.col("value_num").isNull()).alias("unitless"), F.bool_or(F.coalesce("variant_conflict", F.lit(False))).alias("variant_conflict"))
    base = subjects(mentions, params, profiles, asked).join(flags, KEYS, "left").join(spread, KEYS, "left").join(_norm_breaches(live, norms), KEYS, "left")
    values = base.join(stages, KEYS, "left")
    first = earliest("value_num")
    scaled, bad, farthest = F.lit(False), F.lit(False), F.lit(None).cast("double")
    for s in STAGES:
        v = F.col(f"{s.lower()}_value_num")
        ratio = F.greatest(v, first) / F.least(v, first)
        near = F.exists("factors", lambda f: (ratio >= f * 0.5) & (ratio <= f * 1.5))  # noqa: B023
        scaled = scaled | is_later(s) & true((v > 0) & (first > 0) & near)
        off = is_later(s) & true(_side_breach(v, first))
        bad = bad | off
        farthest = F.when(off & true(farthest.isNull() | (F.abs(v - first) > F.abs(farthest - first))), v).otherwise(farthest)
    status = ladder(
        (F.col("not_applicable"), NA),
        (true(F.col("any_disputed")), CL),
        (F.col("norm_value").isNotNull(), CA),
        (true(F.col("variant_conflict")), NC),
        ((n_stages() < 2) & true(F.col("unitless")), NC),
        (n_stages() < 2, ME),
        (true(F.col("spread")), NC),
        (scaled, NC),
        (bad, CA),
        otherwise=NV,
    )
    judged = values.select(*KEYS, "part", status.alias("status"), F.coalesce("norm_value", F.when(status == CA, farthest)).alias("actual"))
    worst = F.struct(_worst(F.col("status")), F.coalesce("part", F.lit("")))
    return judged.groupBy(*KEYS).agg(F.min_by("status", worst).alias("status"), F.min_by("actual", worst).alias("actual"), F.count("*").alias("parts"))


#: What counts of several elements, worst first.
ELEMENTS_WORST = (CA, CL, NC, NV, ME, NA)


def _worst(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ELEMENTS_WORST)), status)


def _per_stage(parts: list[str]):
    from pyspark.sql import Window as W

    return W.partitionBy(*parts, "stage").orderBy(F.desc_nulls_last("confidence"), "file_id", "page", "value_num")


def _norm_breaches(live: DataFrame, norms: DataFrame | None) -> DataFrame:
    """The value farthest beyond a norm that must hold, of each object and param that has one."""
    if norms is None:
        return live.select(*KEYS).limit(0).withColumn("norm_value", F.lit(None).cast("double"))
    met = live.join(F.broadcast(norms.where("severity = 'fail'")), "param_code")
    over = F.when(F.col("side") == "min", F.col("bound") - F.col("value_num")).otherwise(F.col("value_num") - F.col("bound"))
    met = met.withColumn("over", over).where(F.col("over") > SLACK)
    return met.groupBy(*KEYS).agg(F.max_by("value_num", F.struct("over", "value_num")).alias("norm_value"))


@kind("count")
def count(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Findings for counts of things: whole numbers only, any difference counts.

    A stage that names different numbers itself makes a difference a question, not a finding.
    """
    rows = of(mentions, params).where((F.col("value_num") == F.floor("value_num")) & (F.col("value_num") >= 0))
    within = rows.where(F.col("stage").isin(*STAGES)).groupBy(*KEYS, "stage").agg((F.countDistinct("value_num") > 1).alias("disagree"))
    disagree = within.groupBy(*KEYS).agg(F.bool_or("disagree").alias("disagree"))
    stages = wide(picked(rows), "value_num")
    values = subjects(mentions, params, profiles, asked).join(stages, KEYS, "left").join(disagree, KEYS, "left")
    differs = F.lit(False)
    for s in STAGES:
        differs = differs | is_later(s) & true(F.col(f"{s.lower()}_value_num") != earliest("value_num"))
    status = ladder(
        (F.col("not_applicable"), NA), (true(F.col("any_disputed")), CL), (n_stages() < 2, ME), (~differs, NV), (true(F.col("disagree")), CL), otherwise=CA
    )
    return values.select(*KEYS, status.alias("status"), *[F.when(has(s), F.col(f"{s.lower()}_value_num")).alias(s.lower()) for s in STAGES])
