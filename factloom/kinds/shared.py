"""What the kinds share.

Mentions have object_id, param_code, stage (PD, RD, ID), value_num, value_text, role, confidence, file_id, page, and
whatever else a kind reads; params have param_code, kind, applicability and the kind's own settings. A finding has
object_id, param_code and status; the pairs asked for are those of ``asked``, or all that have a mention.

Params and catalogues (aliases, analogs, lineage, norms) are a caller's lists and go to every task: joined by a shuffle,
all mentions of one param or of one name would be in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.picks import first_per

STAGES = ("PD", "RD", "ID")
KEYS = ["object_id", "param_code"]
#: Roles of a document whose current revision isn't settled.
DISPUTED = ("CONFLICT", "UNRESOLVED")

NA, CL, ME, NC, CA, NV = "NOT_APPLICABLE", "CLARIFICATION_REQUIRED", "MISSING_EVIDENCE", "NOT_COMPARABLE", "CANDIDATE", "NEGATIVE_VERIFIED"


def subjects(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None, asked: DataFrame | None) -> DataFrame:
    """The pairs to evaluate with their params and not_applicable: an object whose profile denies what a param needs."""
    return _denied((asked if asked is not None else mentions).select(*KEYS).distinct().join(F.broadcast(params), "param_code"), profiles)


def applied(found: DataFrame, params: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """What was found of pairs, a row each, with not_applicable: ``subjects`` that need not be looked for again."""
    return _denied(found.join(F.broadcast(params.select("param_code", *({"applicability"} & {*params.columns}))), "param_code"), profiles)


def _denied(pairs: DataFrame, profiles: DataFrame | None) -> DataFrame:
    if profiles is None or "applicability" not in pairs.columns:
        return pairs.withColumn("not_applicable", F.lit(False))
    denied = profiles.where(~F.col("value")).select("object_id", F.col("flag").alias("applicability")).distinct().withColumn("denied", F.lit(True))
    return pairs.join(denied, ["object_id", "applicability"], "left").withColumn("not_applicable", F.coalesce("denied", F.lit(False))).drop("denied")


def of(mentions: DataFrame, params: DataFrame) -> DataFrame:
    return mentions.join(F.broadcast(params.select("param_code")), "param_code", "left_semi")


def picked(mentions: DataFrame, *before: Column) -> DataFrame:
    """One mention of each object, param and stage: the caller's order, then confidence, file and page."""
    order = [*before, F.desc_nulls_last("confidence"), F.asc("file_id"), F.asc("page"), F.asc("value_num"), F.asc("value_text")]
    return first_per(mentions.where(F.col("stage").isin(*STAGES)), [*KEYS, "stage"], order)


def wide(rows: DataFrame, *columns: str, keys: list[str] = KEYS) -> DataFrame:
    """A row of each key with the columns of each stage, as pd_x, rd_x, id_x, has_pd and so on, and any_disputed."""
    cells = [F.max(F.when(F.col("stage") == s, F.col(c))).alias(f"{s.lower()}_{c}") for s in STAGES for c in columns]
    seen = [F.coalesce(F.bool_or(F.col("stage") == s), F.lit(False)).alias(f"has_{s.lower()}") for s in STAGES]
    return rows.groupBy(*keys).agg(*cells, *seen, F.bool_or(disputed()).alias("any_disputed"))


def disputed() -> Column:
    return F.coalesce(F.col("role").isin(*DISPUTED), F.lit(False))


def has(stage: str) -> Column:
    return F.coalesce(F.col(f"has_{stage.lower()}"), F.lit(False))


def n_stages() -> Column:
    return sum((has(s).cast("int") for s in STAGES), F.lit(0))


def earliest(column: str) -> Column:
    """The column at the earliest stage that has a value."""
    return F.when(has("PD"), F.col(f"pd_{column}")).when(has("RD"), F.col(f"rd_{column}")).when(has("ID"), F.col(f"id_{column}"))


def earliest_stage() -> Column:
    return F.when(has("PD"), "PD").when(has("RD"), "RD").when(has("ID"), "ID")


def is_later(stage: str) -> Column:
    """Whether the stage has a value and isn't the earliest that has one."""
    return has(stage) & (earliest_stage() != stage)


def true(condition: Column) -> Column:
    """The condition, false where it is unknown."""
    return F.coalesce(condition, F.lit(False))
