"""Kinds over statements that something is there or how it is made, by aspect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.kinds.registry import kind
from factloom.kinds.shared import CA, CL, KEYS, ME, NA, NC, NV, STAGES, disputed, has, of, subjects, true
from factloom.operators.compare import ladder

#: Of several aspects, worst first.
ASPECTS_WORST = (CA, NC, ME, NV, NA)


@kind("presence")
def presence(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Findings for what a design promises: statements say PRESENT or ABSENT of an aspect, with a count or measure if any.

    Mentions have aspect, state and hint (a reference elsewhere, which says nothing by itself). A stage with both states
    is mixed. Silence is never a violation: a later stage that says nothing is missing evidence. Of a param's aspects
    the worst counts; where none applies, a design that excludes the thing makes it not applicable, and one that is
    silent is what the param's pd_silent says.
    """
    rows = of(mentions, params).where(F.col("stage").isin(*STAGES))
    said = lambda s: F.coalesce(F.bool_or((F.col("state") == s) & ~F.coalesce("hint", F.lit(False))), F.lit(False))
    by = rows.groupBy(*KEYS, "aspect", "stage").agg(said("PRESENT").alias("p"), said("ABSENT").alias("a"), F.bool_or(F.coalesce("hint", F.lit(False))).alias("h"), F.max("value_num").alias("measure"))
    state = F.when(F.col("p") & F.col("a"), "MIXED").when(F.col("p"), "PRESENT").when(F.col("a"), "ABSENT").when(F.col("h"), "HINT")
    cell = lambda s, c: F.max(F.when(F.col("stage") == s, c)).alias(f"{s.lower()}_{'state' if c is state else 'measure'}")
    aspects = by.groupBy(*KEYS, "aspect").agg(*[cell(s, c) for s in STAGES for c in (state, F.col("measure"))])
    flags = rows.groupBy(*KEYS).agg(F.bool_or(disputed()).alias("any_disputed"), F.bool_or(F.col("stage") == "PD").alias("has_pd"), F.bool_or((F.col("stage") == "PD") & (F.col("state") == "ABSENT")).alias("excluded"))
    loaded = [s for s in ("RD", "ID")]
    any_later = lambda value: true(F.col("rd_state") == value) | true(F.col("id_state") == value)
    pd, worse = F.coalesce("pd_state", F.lit("SILENT")), F.lit(False)
    for s in loaded:
        worse = worse | true(F.col(f"{s.lower()}_measure") < F.col("pd_measure"))
    silent = F.col("rd_state").isNull() | F.col("id_state").isNull()
    status = ladder(
        (pd.isin("SILENT", "ABSENT", "HINT"), NA),
        (pd == "MIXED", NC),
        (any_later("ABSENT"), CA),
        (any_later("MIXED"), NC),
        (any_later("HINT") & ~any_later("PRESENT"), NC),
        (silent, ME),
        (worse, CA),
        otherwise=NV,
    )
    order = F.array_position(F.array(*map(F.lit, ASPECTS_WORST)), F.col("aspect_status"))
    judged = aspects.withColumn("aspect_status", status)
    rolled = judged.groupBy(*KEYS).agg(F.min_by("aspect_status", F.struct(order, F.col("aspect"))).alias("worst"), F.min_by("aspect", F.struct(order, F.col("aspect"))).alias("aspect"))
    values = subjects(mentions, params, profiles, asked).join(flags, KEYS, "left").join(rolled, KEYS, "left")
    total = ladder(
        (F.col("not_applicable"), NA),
        (true(F.col("any_disputed")), CL),
        (~has("PD"), ME),
        ((F.col("worst") == NA) & true(F.col("excluded")), NA),
        ((F.col("worst") == NA) & (F.col("pd_silent") == NA), NA),
        (F.col("worst") == NA, ME),
        otherwise=F.col("worst"),
    )
    return values.select(*KEYS, total.alias("status"), F.when(has("PD"), F.col("aspect")).alias("aspect"))


@kind("method")
def method(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None, lineage: DataFrame | None = None) -> DataFrame:
    """Findings for how something is made: terms (value_text) of a catalogue by stage.

    ``lineage`` (term, ancestor) has every term of the catalogue with itself and all it is a kind of. A later term that
    is the design's or a kind of it is as designed; another known one is a finding, an unknown one can't be compared.
    """
    rows = of(mentions, params).where(F.col("stage").isin(*STAGES))
    known = lineage.select(F.col("term").alias("value_text")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(F.broadcast(known), "value_text", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    flags = rows.groupBy(*KEYS).agg(
        F.bool_or(disputed()).alias("any_disputed"),
        F.bool_or(F.col("stage") == "PD").alias("has_pd"),
        F.bool_or((F.col("stage") == "PD") & F.col("known")).alias("pd_known"),
        F.bool_or((F.col("stage") != "PD") & ~F.col("known")).alias("unrecognised"),
        F.bool_or(F.col("stage") != "PD").alias("said_later"),
    )
    designed = rows.where((F.col("stage") == "PD") & F.col("known")).select(*KEYS, F.col("value_text").alias("ancestor")).distinct()
    later = rows.where((F.col("stage") != "PD") & F.col("known")).select(*KEYS, F.col("value_text").alias("term")).distinct()
    of_kind = later.join(F.broadcast(lineage), "term").join(designed, [*KEYS, "ancestor"]).select(*KEYS, "term").distinct().withColumn("fits", F.lit(True))
    fits = later.join(of_kind, [*KEYS, "term"], "left").groupBy(*KEYS).agg(F.bool_or(F.col("fits").isNull()).alias("unrelated"), F.bool_or(F.coalesce("fits", F.lit(False))).alias("related"))
    values = subjects(mentions, params, profiles, asked).join(flags, KEYS, "left").join(fits, KEYS, "left")
    status = ladder(
        (F.col("not_applicable"), NA),
        (true(F.col("any_disputed")), CL),
        (~has("PD"), NA),
        (~true(F.col("pd_known")), NC),
        (true(F.col("unrelated")), CA),
        (true(F.col("related")), NV),
        (true(F.col("unrecognised")), NC),
        otherwise=ME,
    )
    return values.select(*KEYS, status.alias("status"))
