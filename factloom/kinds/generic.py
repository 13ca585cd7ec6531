"""The generic kind: six rules over one value for each stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.kinds.registry import kind
from factloom.kinds.shared import CA, CL, KEYS, ME, NA, NC, NV, STAGES, disputed, earliest, earliest_stage, has, is_later, n_stages, of, picked, subjects, true, wide
from factloom.operators.compare import ladder


def place(scale: Column, value: Column) -> Column:
    """Rank of a text on a param's own scale; null off it."""
    at = F.array_position(scale, value)
    return F.when(at > 0, at).cast("double")


def breach(rule: Column, tolerance: Column, scale: Column, e_num: Column, e_text: Column, a_num: Column, a_text: Column) -> Column:
    """Whether an actual value breaks the rule against the expected one; null if the two can't be compared.

    Numbers are compared as numbers if both sides have one; else equality is of texts and order by the param's scale.
    """
    numeric = e_num.isNotNull() & a_num.isNotNull()
    e = F.when(numeric, e_num).otherwise(place(scale, e_text))
    a = F.when(numeric, a_num).otherwise(place(scale, a_text))
    percent = F.when(numeric & (e_num != 0), F.abs((a_num - e_num) / e_num) * 100 > tolerance)
    equal = F.when(numeric, a_num != e_num).otherwise(a_text != e_text)
    return F.when(rule == "delta_pct", percent).when(rule == "equal", equal).when(rule == "decrease", a < e).when(rule == "increase", a > e)


@kind("generic")
def generic(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Findings by the rule of each param: equal, delta_pct (tolerance), decrease, increase, min (low) or max (high).

    Thresholds hold for each stage alone; the others compare the later stages with the earliest one that has a value.
    Params have rule, tolerance, low, high and scale (texts from the lowest). worst_stage is the last stage in breach.
    """
    rows = picked(of(mentions, params))
    base = subjects(mentions, params, profiles, asked)
    disputes = rows.groupBy(*KEYS).agg(F.bool_or(disputed()).alias("any_disputed"))
    values = base.join(wide(rows, "value_num", "value_text").drop("any_disputed"), KEYS, "left").join(disputes, KEYS, "left")
    threshold = F.col("rule").isin("min", "max")
    over = lambda s: true(F.when(F.col("rule") == "min", F.col(f"{s}_value_num") < F.col("low")).otherwise(F.col(f"{s}_value_num") > F.col("high")))
    against = {
        s: F.when(is_later(s), breach(F.col("rule"), F.col("tolerance"), F.col("scale"), earliest("value_num"), earliest("value_text"), F.col(f"{s.lower()}_value_num"), F.col(f"{s.lower()}_value_text")))
        for s in STAGES
    }
    no_number = F.lit(False)
    incomparable = F.lit(False)
    for s in STAGES:
        no_number = no_number | has(s) & F.col(f"{s.lower()}_value_num").isNull()
        incomparable = incomparable | is_later(s) & against[s].isNull()
    bad = {s: F.when(threshold, has(s) & over(s.lower())).otherwise(true(against[s])) for s in STAGES}
    any_bad = bad["PD"] | bad["RD"] | bad["ID"]
    status = ladder(
        (F.col("not_applicable"), NA),
        (true(F.col("any_disputed")), CL),
        (threshold & (n_stages() == 0), ME),
        (threshold & no_number, NC),
        (threshold & any_bad, CA),
        (threshold, NV),
        (n_stages() < 2, ME),
        (incomparable, NC),
        (any_bad, CA),
        otherwise=NV,
    )
    worst = F.when(bad["ID"], "ID").when(bad["RD"], "RD").when(bad["PD"], "PD")
    found = values.withColumn("status", status)
    return found.select(*KEYS, "status", F.when(F.col("status") == CA, F.when(~threshold, earliest_stage())).alias("expected_stage"), F.when(F.col("status") == CA, worst).alias("worst_stage"))
