"""Kinds over names of types: classes on a scale, categories with substitutes, and compositions of several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.classes import DIMENSIONS, PART, known, lost, vector
from factloom.kinds.generic import place
from factloom.kinds.registry import kind
from factloom.kinds.shared import CA, CL, KEYS, ME, NA, NC, NV, STAGES, disputed, has, n_stages, of, picked, subjects, true, wide
from factloom.operators.compare import ladder
from factloom.operators.picks import first_per
from factloom.sources.shared import checkpointed

#: Notations of classes that go to every task; more are spread by themselves.
MOST_NOTATIONS = 100_000


@kind("class")
def class_(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Findings for classes on a param's scale (texts, lowest first); a later class below the earlier one is a finding.

    Mentions may name an element; an element's later value meets the earlier value of that element, or else the general
    one. As built is compared with the working documents first where the param's cert_match says so, else with the
    earliest stage. A value off the scale is of another classification system: alone it makes nothing comparable.

    A scale may have dimensions (params.dims: name, kind, tokens, implies; kinds are number, ladder and flags) instead
    of an order. A class that is worse in any of them is a finding, even if it is better in another; drop is then the
    number of dimensions in which it is worse.
    """
    dims = F.coalesce("dims", F.array().cast(DIMENSIONS)) if "dims" in params.columns else F.array().cast(DIMENSIONS)
    params = params.withColumn("_dims", dims)
    has_dims = F.col("_dims_n") > 0
    rows = of(mentions, params).withColumn("element", F.coalesce("element", F.lit("")))
    order = [F.desc_nulls_last("confidence"), F.asc("file_id"), F.asc("page"), F.asc("value_text")]
    chosen = first_per(rows.where(F.col("stage").isin(*STAGES)), [*KEYS, "element", "stage"], order).join(F.broadcast(params.select("param_code", "scale", "cert_match", F.size("_dims").alias("_dims_n"))), "param_code")
    chosen = _with_vectors(chosen, rows, params) if "dims" in params.columns else chosen.withColumn("vector", F.lit(None).cast(f"array<{PART}>"))
    rank = F.when(has_dims, F.when(known(F.col("vector")), 1.0)).otherwise(place(F.col("scale"), F.col("value_text")))
    chosen = chosen.select(*KEYS, "element", "stage", "role", "cert_match", rank.alias("rank"), "vector")
    number = lambda c: F.array_position(F.array(*map(F.lit, STAGES)), F.col(c))
    later = chosen.where(number("stage") > 1).select(*KEYS, "element", F.col("stage").alias("later"), F.col("rank").alias("now"), F.col("vector").alias("now_vector"), "cert_match")
    before = chosen.select(*KEYS, F.col("element").alias("of"), F.col("stage").alias("earlier"), F.col("rank").alias("was"), F.col("vector").alias("was_vector"))
    met = later.join(before, KEYS).where((number("earlier") < number("later")) & ((F.col("of") == F.col("element")) | (F.col("of") == "")))
    certified = F.col("cert_match") & (F.col("later") == "ID") & (F.col("earlier") == "RD")
    pairs = first_per(met, [*KEYS, "element", "later"], [F.desc(F.col("of") == F.col("element")), F.desc(certified), F.asc(number("earlier"))])
    both = F.col("was").isNotNull() & F.col("now").isNotNull()
    drop = F.when(both & F.col("was_vector").isNotNull(), lost(F.col("was_vector"), F.col("now_vector")).cast("double")).otherwise(F.col("was") - F.col("now"))
    found = pairs.groupBy(*KEYS).agg(F.count("*").alias("pairs"), F.max(drop).alias("drop"), F.bool_or(drop.isNull()).alias("incomparable"))
    seen = chosen.groupBy(*KEYS).agg(
        F.countDistinct(F.when(F.col("rank").isNotNull(), F.col("stage"))).alias("ranked_stages"), F.bool_or(F.col("rank").isNull()).alias("other_system"), F.bool_or(disputed()).alias("any_disputed")
    )
    values = subjects(mentions, params, profiles, asked).join(seen, KEYS, "left").join(found, KEYS, "left")
    few = F.coalesce("ranked_stages", F.lit(0)) < 2
    status = ladder(
        (F.col("not_applicable"), NA),
        (true(F.col("any_disputed")), CL),
        (few & true(F.col("other_system")), NC),
        (few, ME),
        (F.col("pairs").isNull(), NC),
        (true(F.col("drop") > 0), CA),
        (true(F.col("incomparable")), NC),
        otherwise=NV,
    )
    return values.select(*KEYS, status.alias("status"), F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), F.when(F.col("drop") > 0, F.col("drop")).alias("drop"))


def _with_vectors(chosen: DataFrame, rows: DataFrame, params: DataFrame) -> DataFrame:
    """Classes with their vectors, null where the param has no dimensions; a notation is read once, however often it comes."""
    pairs = rows.select("param_code", "value_text").distinct().join(F.broadcast(params.select("param_code", "_dims").where(F.size("_dims") > 0)), "param_code")
    read = checkpointed(pairs.select(F.col("param_code").alias("_param"), F.col("value_text").alias("_text"), vector(F.col("_dims"), F.col("value_text")).alias("vector")))
    notations = F.broadcast(read) if read.count() <= MOST_NOTATIONS else read
    return chosen.join(notations, (F.col("param_code") == F.col("_param")) & F.col("value_text").eqNullSafe(F.col("_text")), "left").drop("_param", "_text")


@kind("composition")
def composition(mentions: DataFrame, params: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Findings for compositions: types (value_text) with amounts (value_num) by stage.

    The first later stage with an added or removed type, or a share moved by more than the param's tolerance in
    percentage points, is a finding; a type that the param's separate counts apart and that one side alone has makes
    the two incomparable. There is no question of applicability or revision here.
    """
    rows = of(mentions, params).where(F.col("stage").isin(*STAGES))
    amounts = rows.groupBy(*KEYS, "stage", "value_text").agg(F.sum("value_num").alias("amount"))
    totals = amounts.groupBy(*KEYS, "stage").agg(F.sum("amount").alias("total"))
    number = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    firsts = totals.groupBy(*KEYS).agg(F.min(number).alias("first"), F.count("*").alias("stages"))
    shares = amounts.join(totals, [*KEYS, "stage"]).join(firsts, KEYS).select(*KEYS, "first", number.alias("stage"), "value_text", F.try_divide(F.col("amount") * 100, F.col("total")).alias("share"))
    old = shares.where("stage = first").select(*KEYS, "value_text", F.col("share").alias("was"))
    later = totals.join(firsts, KEYS).select(*KEYS, number.alias("stage"), "first").where("stage > first").select(*KEYS, "stage")
    new = shares.where("stage > first").select(*KEYS, "stage", "value_text", F.col("share").alias("now"))
    both = old.join(later, KEYS).join(new, [*KEYS, "stage", "value_text"], "full_outer").join(F.broadcast(params.select("param_code", "tolerance", "separate")), "param_code")
    one_sided = F.col("was").isNull() | F.col("now").isNull()
    apart = true(F.array_contains("separate", F.col("value_text")))
    moved = one_sided & ~apart | true(F.abs(F.col("now") - F.col("was")) > F.col("tolerance"))
    flags = both.groupBy(*KEYS).agg(F.bool_or(one_sided & apart).alias("incomparable"), F.min(F.when(moved, F.col("stage"))).alias("changed"))
    values = subjects(mentions, params, None, asked).join(firsts, KEYS, "left").join(flags, KEYS, "left")
    status = ladder((F.coalesce("stages", F.lit(0)) < 2, ME), (true(F.col("incomparable")), NC), (F.col("changed").isNotNull(), CA), otherwise=NV)
    stage = F.element_at(F.array(*map(F.lit, STAGES)), F.col("changed").cast("int"))
    return values.select(*KEYS, status.alias("status"), F.when(status == CA, stage).alias("changed_stage"))


@kind("category")
def category(
    mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None, aliases: DataFrame | None = None, analogs: DataFrame | None = None
) -> DataFrame:
    """Findings for products and materials named instead of a value.

    Names of one alias group (name, canonical) are the same; a later one that analogs (canonical, substitute, verdict)
    calls EQUIVALENT is as good, one that it calls NOT_EQUIVALENT is a finding, and one it doesn't know is undecided.
    """
    rows = picked(of(mentions, params).where(F.col("value_text").isNotNull()))
    if aliases is not None:
        rows = rows.join(F.broadcast(aliases.select(F.col("name").alias("value_text"), "canonical")), "value_text", "left")
    rows = rows.withColumn("name", F.coalesce("canonical", "value_text") if aliases is not None else F.col("value_text"))
    stages = wide(rows, "name")
    sides = stages.select(*KEYS, F.col("pd_name").alias("was"), F.explode(F.array("rd_name", "id_name")).alias("now")).where("was is not null and now is not null")
    known = analogs.select(F.col("canonical").alias("was"), F.col("substitute").alias("now"), "verdict") if analogs is not None else sides.select("was", "now").limit(0).withColumn("verdict", F.lit(""))
    decided = sides.join(F.broadcast(known) if analogs is not None else known, ["was", "now"], "left").withColumn("decision", F.when(F.col("was") == F.col("now"), "SAME").otherwise(F.coalesce("verdict", F.lit("UNKNOWN"))))
    flags = decided.groupBy(*KEYS).agg(*[F.bool_or(F.col("decision") == d).alias(d.lower()) for d in ("SAME", "EQUIVALENT", "NOT_EQUIVALENT", "UNKNOWN")])
    values = subjects(mentions, params, profiles, asked).join(stages, KEYS, "left").join(flags, KEYS, "left")
    status = ladder(
        (F.col("not_applicable"), NA),
        (true(F.col("any_disputed")), CL),
        (~has("PD") | ~has("RD") & ~has("ID"), ME),
        (true(F.col("not_equivalent")), CA),
        (true(F.col("unknown")), NC),
        (true(F.col("same") | F.col("equivalent")), NV),
        otherwise=NC,
    )
    return values.select(*KEYS, status.alias("status"), n_stages().alias("stages"))
