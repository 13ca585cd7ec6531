"""The kind of doors on ways of escape: which way they open, by mark and building, against an earlier stage or the norm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.checks import is_named_source
from factloom.kinds.registry import kind
from factloom.kinds.shared import CA, CL, KEYS, ME, NA, NC, NV, STAGES, applied, disputed, of, subjects, true
from factloom.operators.compare import ladder
from factloom.operators.picks import first_per
from factloom.sources.shared import checkpointed

#: Ways that are worse than outward, ways that tell nothing, and why a mention doesn't count: it can't be
#: read as a way, its door needs none, or only the side of the hinges or a drawing tells.
BAD, SILENT = ("inward", "sliding"), ("hand", "graphic")
UNCLEAR, OUTSIDE, UNREADABLE, EXEMPT = ("NEGATION", "AMBIGUOUS"), ("NOT_EVAC", "SMALL_ROOM"), ("HAND_ONLY", "GRAPHIC_ONLY"), "EXEMPT"
ROLES = ("CURRENT", "CONFLICT", "UNRESOLVED")


def _listed(column: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*names), F.lit(False))


def _number(column: str = "stage") -> Column:
    return F.array_position(F.array(*map(F.lit, STAGES)), F.col(column))


def _read(mentions: DataFrame, params: DataFrame) -> DataFrame:
    """All mentions with what ``readings`` tells of them, norm, and fit: whether they count."""
    rows = of(mentions, params).join(F.broadcast(params.select("param_code", "sources", "norm")), "param_code")
    own = F.coalesce(F.element_at("sources", F.col("stage")), F.array().cast("array<string>"))
    place = F.array_position(own, F.coalesce("discipline", F.lit("")))
    rank = F.when(place > 0, place).otherwise(F.coalesce(F.nullif(F.array_position(own, "*"), F.lit(0)), F.size(own) + 1))
    unclear = _listed("excluded", UNCLEAR)
    fit = F.col("stage").isin(*STAGES) & ~true(F.col("role") == "SUPERSEDED") & (unclear | is_named_source(own, F.col("discipline")))
    free = F.col("excluded").isNull()
    return rows.select(
        *KEYS, "stage", "role", "mark", "building", "value", "confidence", "file_id", "page", "exemption", true(F.col("evac")).alias("evac"), rank.alias("rank"), unclear.alias("unclear"),
        (~unclear & (true(F.col("excluded") == EXEMPT) | F.col("exemption").isNotNull())).alias("exempt"), (_listed("excluded", UNREADABLE) | free & F.col("value").isin(*SILENT)).alias("silent"),
        _listed("excluded", OUTSIDE).alias("outside"), (free & ~F.col("value").isin(*SILENT)).alias("way"), F.col("value").isin(*BAD).alias("bad"), "norm", true(fit).alias("fit"),
    )


def readings(mentions: DataFrame, params: DataFrame) -> DataFrame:
    """Mentions that aren't of a past revision, with what they are good for: way, exempt, silent, outside or unclear.

    What can't be read counts whatever its discipline; else the discipline must be in the param's list of the stage
    (sources, a map by stage), where a star takes all and an empty list none.
    """
    return _read(mentions, params).where("fit").drop("norm", "fit")


def _order() -> list[Column]:
    """The order of the doors of a stage."""
    return [F.asc("rank"), F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")), F.desc_nulls_last("confidence"), F.desc("bad"), F.asc("file_id"), F.asc("page"), F.asc("value"), F.asc_nulls_first("mark"), F.asc_nulls_first("building")]


def doors(read: DataFrame) -> DataFrame:
    """The first mention of each door (mark and building, null for what is said of all) of a stage, numbered in order."""
    ways = read.where("way").withColumn("no", F.row_number().over(W.partitionBy(*KEYS, "stage").orderBy(*_order())))
    return first_per(ways, [*KEYS, "stage", "mark", "building"], [F.asc("no")])


def _compatible(a: str, b: str) -> Column:
    """Buildings agree, or one isn't named."""
    return F.coalesce(F.col(a) == F.col(b), F.lit(True))


def compared(read: DataFrame) -> DataFrame:
    """All readings with door (whether it is the first of its door) and known (its mark is of a door on a way of escape);
    a door of a later stage has outcome (pair, norm, other, unknown, blocks or none), violation and excused.

    A door meets its own mark in the earliest stage that has doors, in a building that agrees, else what is said there of
    all doors, else the norm. Without its own mark only a door on a way of escape can break anything. An exemption
    excuses it that is named for it, in its own stage or the earliest. Whoever it meets is of its object and param, so
    that it is found by windows where these are, and nothing is joined.
    """
    by = lambda *more: W.partitionBy(*KEYS, *more)
    rows = read.withColumn("_idle", ~true(F.col("fit") & F.col("way"))).withColumn("_at", F.row_number().over(by().orderBy("_idle", "stage", *_order())))
    rows = rows.withColumn("_no", F.col("_at") - F.min("_at").over(by("_idle", "stage")))
    rows = rows.withColumn("door", ~F.col("_idle") & (F.col("_no") == F.min("_no").over(by("mark", "building", "_idle", "stage"))))
    rows = rows.withColumn("_first", F.min(F.when(F.col("door"), _number())).over(by()))
    base, nowhere, general = F.col("door") & (_number() == F.col("_first")), F.col("building").isNull(), F.col("mark").isNull()
    least = lambda condition, *more: F.min(F.when(condition, F.struct("_no", "value"))).over(by(*more))
    rows = rows.withColumn("_own_same", least(base, "mark", "building"))
    rows = rows.withColumns({
        "_own_any": least(base, "mark"), "_own_null": least(base & nowhere, "mark"), "known": F.bool_or(~F.col("_idle") & F.col("evac")).over(by("mark")) & ~general,
        "_excused": F.collect_set(F.when(F.col("fit") & F.col("exempt"), _number())).over(by("mark")),
    })
    rows = rows.withColumns({"_general_any": least(base & general), "_general_null": least(base & general & nowhere)}).withColumn("_general_same", least(base & general, "building"))
    met = F.col("door") & (_number() > F.col("_first"))
    was = lambda kind: F.when(met, F.when(nowhere, F.col(f"_{kind}_any")).otherwise(F.least(f"_{kind}_same", f"_{kind}_null")))["value"]
    rows = rows.withColumns({"_own": F.when(~general, was("own")), "_elsewhere": met & ~general & F.col("_own_any").isNotNull(), "_general": was("general"), "_escape": F.col("evac") | F.col("known")})
    blocks, norm, escape = F.col("value") == "blocks", true(F.col("norm")), F.col("_escape")
    outcome = (
        F.when(blocks, F.when(escape, "blocks").otherwise("unknown")).when(F.col("_own").isNotNull(), "pair").when(F.col("_elsewhere"), "other")
        .when(F.col("bad") & ~escape, F.when(F.col("_general").isNotNull() | norm, "unknown").otherwise("none"))
        .when(F.col("_general").isNotNull(), "pair").when(norm & F.col("bad"), "norm").otherwise("none")
    )
    rows = rows.withColumn("outcome", F.when(F.col("door") & (F.col("stage") != "PD"), outcome))
    worse = (F.col("outcome") == "norm") | (F.col("outcome") == "pair") & (F.coalesce("_own", "_general") == "outward")
    excused = lambda stage: F.array_contains("_excused", stage)
    near = excused(_number()) | (F.col("_first") < _number()) & excused(F.col("_first"))
    return rows.withColumn("violation", true(F.col("bad") & worse)).withColumn("excused", F.col("exemption").isNotNull() | true(near))


def conflicts(mentions: DataFrame, params: DataFrame) -> DataFrame:
    """KEYS, stage, doors named differently and inward: doors on a way of escape that belie what the stage says of all."""
    read = checkpointed(readings(mentions, params))
    ways = read.where("way")
    split = ways.groupBy(*KEYS, "stage", "mark", "building").agg(F.countDistinct("value").alias("n")).where("n > 1").groupBy(*KEYS, "stage").agg(F.count("*").alias("named_differently"))
    general = first_per(doors(read).where("mark is null"), [*KEYS, "stage"], [F.asc("no")]).where("value = 'outward'").select(*KEYS, "stage", F.col("building").alias("said_of"))
    inward = ways.where("mark is not null and evac and bad").join(general, [*KEYS, "stage"]).where(_compatible("building", "said_of")).groupBy(*KEYS, "stage").agg(F.count("*").alias("inward"))
    both = split.join(inward, [*KEYS, "stage"], "full_outer")
    return both.select(*KEYS, "stage", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("named_differently", "inward")])


@kind("direction")
def direction(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Findings for the way doors open, with pairs compared and violations.

    A door that has turned inward is a finding unless an exemption is named for it, or for all where it has no mark: then
    nobody can tell without the plan. Params have sources (map of stage to disciplines) and norm, whether a norm asks for
    outward doors where nothing else does.
    """
    met = compared(_read(mentions, params))
    later, violation, excused = F.col("fit") & (F.col("stage") != "PD"), F.col("violation"), F.col("excused")
    found = met.groupBy(*KEYS).agg(
        F.bool_or(F.col("door") & disputed()).alias("any_disputed"), F.bool_or(violation & ~excused).alias("hard"), F.bool_or(violation & excused).alias("soft"),
        F.count_if(F.col("outcome") == "pair").alias("pairs"), F.count_if(violation).alias("violations"), *[F.bool_or(F.col("outcome") == o).alias(o) for o in ("blocks", "other", "unknown")],
        F.bool_or(later & F.col("unclear") & (F.col("evac") | F.col("known"))).alias("lost"), F.bool_or(later & F.col("silent")).alias("silent"), F.bool_or(later & F.col("outside")).alias("outside"),
    )
    values = applied(found, params, profiles) if asked is None else subjects(mentions, params, profiles, asked).join(found, KEYS, "left")
    flag = lambda c: true(F.col(c))
    status = ladder(
        (F.col("not_applicable"), NA), (flag("any_disputed"), CL), (flag("hard"), CA), (flag("soft"), NC), (flag("blocks"), NC), (flag("lost"), NC),
        (F.coalesce("pairs", F.lit(0)) > 0, NV), (flag("other") | flag("silent") | flag("unknown"), NC), (flag("outside"), NV), otherwise=ME,
    )
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return values.select(*KEYS, status.alias("status"), n("pairs"), n("violations"))
