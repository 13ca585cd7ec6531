"""The kind of elements measured on plans: lengths, areas, counts, positions and contours between stages.

A mention is an element: key (its mark, may be null), at ([x, y]), polygon, value with by (dimension or geometry),
label_value and measured_value, frame (bld for the axes of the building), residual_mm (how far the sheet's frame may be
off), scale_n and scale_spread_pct of its sheet. Params have measure and the bounds named in PARAMS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.text import CYRILLIC_TWINS, LATIN_TWINS
from factloom.kinds.registry import kind
from factloom.kinds.shared import CA, CL, KEYS, ME, NA, NC, NV, STAGES, disputed, of, subjects, true
from factloom.operators.compare import SLACK, allowed, ladder
from factloom.operators.geometry import area, hausdorff, polygon_iou
from factloom.operators.match import greedy_pairs
from factloom.operators.spatial import meeting
from factloom.sources.shared import checkpointed

PARAMS = "param_code string, kind string, measure string, aggregate string, direction string, tolerance_abs double, tolerance_pct double, label_pct double, spread_pct double, match_mm double, registration_mm double, iou_min double, hausdorff_mm double, low double, high double"
BUILDING, SCALARS = "bld", ("length", "area", "count")
#: Square millimetres to a square metre, and a distance beyond all others.
SQUARE_METRE, FAR = 1e6, 1.7e308


def scale_fits() -> Column:
    return true((F.col("scale_n") > 0) & (F.col("scale_spread_pct") <= F.col("spread_pct") + SLACK))


def resolved() -> tuple[Column, Column]:
    """An element's value, and whether what is written differs from what is measured.

    What is written counts. A measured length needs a sheet whose scale is known and even; an area is that of the
    contour in the building's millimetres, and a sign that isn't counted is one.
    """
    written = F.coalesce("label_value", F.when(F.col("by") == "dimension", F.col("value")))
    measured = F.coalesce("measured_value", F.when(F.col("by") == "geometry", F.col("value")))
    sure = F.when(scale_fits(), measured)
    factor = F.when(F.col("frame") == BUILDING, 1.0).when(scale_fits(), F.col("scale_n"))
    drawn = F.nullif(area(F.col("polygon")) * factor * factor / SQUARE_METRE, F.lit(0.0))
    drawn = F.when(F.size("polygon") > 0, drawn).otherwise(sure)
    of_plan = F.when(F.col("measure") == "length", sure).when(F.col("measure") == "area", drawn)
    apart = F.abs(of_plan - written) > F.abs(written) * F.col("label_pct") / 100 + SLACK
    one = F.coalesce("value", F.when(F.col("at").isNotNull(), 1.0))
    return F.when(F.col("measure") == "count", one).otherwise(F.coalesce(written, of_plan)), true(apart)


def elements(mentions: DataFrame, params: DataFrame) -> DataFrame:
    """Elements that count, numbered in a stage by file and page: with mark, result and off_scale beside their columns."""
    rows = of(mentions, params).where(F.col("stage").isin(*STAGES) & ~true(F.col("role") == "SUPERSEDED")).join(F.broadcast(params.drop("kind")), "param_code")
    result, off = resolved()
    order = ["file_id", "page", F.col("key"), F.col("at").cast("string"), "value", "label_value", "measured_value", F.col("polygon").cast("string")]
    mark = F.nullif(F.translate(F.regexp_replace(F.upper("key"), r"\s+|\.+$", ""), LATIN_TWINS, CYRILLIC_TWINS), F.lit(""))
    return rows.withColumns({"no": F.row_number().over(W.partitionBy(*KEYS, "stage").orderBy(*order)), "mark": mark, "result": result, "off_scale": off})


def _apart(a: str, b: str) -> Column:
    return F.sqrt(F.pow(F.col(a)[0] - F.col(b)[0], 2) + F.pow(F.col(a)[1] - F.col(b)[1], 2))


def matched(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(KEYS, stage, was_no, no) of elements of the earliest stage and of each later one, and marked ones that have none.

    Elements of one mark are matched nearest first; then those left over by place, within match_mm of each other on one
    frame, of which at least one must have no mark.
    """
    number = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    first = F.min(number).over(W.partitionBy(*KEYS))
    dealt = rows.withColumn("_stage", number).withColumn("_first", first)
    slim = ["no", "mark", "at", "frame"]
    old = dealt.where("_stage = _first").select(*KEYS, *[F.col(c).alias(f"was_{c}") for c in slim])
    new = dealt.where("_stage > _first").select(*KEYS, "stage", *slim, "match_mm")
    stages = new.select(*KEYS, "stage").distinct()
    old = checkpointed(old.join(stages, KEYS))
    together = F.when(F.col("frame") == F.col("was_frame"), _apart("at", "was_at"))
    marked = old.join(new, (F.col("was_mark") == F.col("mark")) & _same(old, new)).select(*[old[c] for c in (*KEYS, "stage")], "mark", "was_no", "no", F.coalesce(together, F.lit(FAR)).alias("distance"))
    by_mark = greedy_pairs(marked, [*KEYS, "stage", "mark"], "was_no", "no", "distance").select(*KEYS, "stage", "was_no", "no")
    left = old.join(by_mark, [*KEYS, "stage", "was_no"], "left_anti")
    right = new.join(by_mark, [*KEYS, "stage", "no"], "left_anti")
    reach = float(rows.agg(F.max("match_mm")).first()[0] or 0.0)
    shaped = lambda df, at, frame, name: df.where(F.col(at).isNotNull()).withColumn(name, F.array(at)).withColumn("_frame", F.coalesce(frame, F.lit("")))
    near = meeting(shaped(left, "was_at", "was_frame", "shape"), shaped(right, "at", "frame", "other"), [*KEYS, "stage", "_frame"], reach, max(reach, 1.0))
    near = near.withColumn("distance", _apart("at", "was_at")).where(F.col("distance") <= F.col("match_mm") + SLACK)
    by_place = greedy_pairs(near.select(*KEYS, "stage", "was_no", "no", "distance", "was_mark", "mark"), [*KEYS, "stage"], "was_no", "no", "distance")
    by_place = by_place.where("was_mark is null or mark is null").select(*KEYS, "stage", "was_no", "no")
    alone = left.where("was_mark is not null").join(by_place, [*KEYS, "stage", "was_no"], "left_anti").select(*KEYS, "stage", "was_no")
    return by_mark.unionByName(by_place), alone


def _same(a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for c in (*KEYS, "stage"):
        out = out & (a[c] == b[c])
    return out


def _pairs_of_values(values: DataFrame) -> DataFrame:
    """KEYS, stage, base, value, tolerance and direction: what a later stage's value is held against.

    Sums, least and largest of a stage meet those of the earliest; each element meets its own, and where a stage has no
    such pair, the least (the largest where growth matters) meets the least.
    """
    each = values.where("aggregate = 'each'")
    pairs, _ = matched(each)
    number = lambda c: F.array_position(F.array(*map(F.lit, STAGES)), F.col(c))
    first = values.groupBy(*KEYS).agg(F.min(number("stage")).alias("_first"))
    later = each.select(*KEYS, "stage", "no", F.col("result").alias("value"))
    base = each.join(first, KEYS).where(number("stage") == F.col("_first")).select(*KEYS, F.col("no").alias("was_no"), F.col("result").alias("base"))
    met = pairs.join(later, [*KEYS, "stage", "no"]).join(base, [*KEYS, "was_no"]).select(*KEYS, "stage", "base", "value")
    mode = F.when(F.col("aggregate") != "each", F.col("aggregate")).when(F.col("direction") == "increase", "max").otherwise("min")
    whole = values.withColumn("_mode", mode).groupBy(*KEYS, "stage", "aggregate", "_mode").agg(F.sum("result").alias("sum"), F.min("result").alias("min"), F.max("result").alias("max"))
    whole = whole.select(*KEYS, "stage", "aggregate", F.when(F.col("_mode") == "sum", F.col("sum")).when(F.col("_mode") == "min", F.col("min")).otherwise(F.col("max")).alias("value")).join(first, KEYS)
    single = whole.where(number("stage") > F.col("_first")).join(whole.where(number("stage") == F.col("_first")).select(*KEYS, F.col("value").alias("base")), KEYS)
    single = single.join(pairs.select(*KEYS, "stage").distinct(), [*KEYS, "stage"], "left_anti").select(*KEYS, "stage", "base", "value")
    return met.unionByName(single)


def _scalar(rows: DataFrame, params: DataFrame) -> DataFrame:
    values = checkpointed(rows.where("result is not null and not isnan(result)"))
    pairs = _pairs_of_values(values).join(F.broadcast(params.select("param_code", "direction", "tolerance_abs", "tolerance_pct")), "param_code")
    delta, most = F.col("value") - F.col("base"), allowed(F.col("tolerance_abs"), F.col("tolerance_pct"), F.col("base"))
    breaks = F.when(F.col("direction") == "decrease", -delta > most + SLACK).when(F.col("direction") == "increase", delta > most + SLACK).otherwise(F.abs(delta) > most + SLACK)
    met = pairs.groupBy(*KEYS).agg(F.count("*").alias("pairs"), F.bool_or(breaks).alias("broken"), F.max(F.when(breaks, F.struct(F.abs(delta).alias("d"), F.col("value").alias("v")))).alias("_far"))
    beyond = (F.col("result") < F.col("low") - SLACK) | (F.col("result") > F.col("high") + SLACK)
    over = F.greatest(F.coalesce(F.col("low") - F.col("result"), F.lit(-FAR)), F.coalesce(F.col("result") - F.col("high"), F.lit(-FAR)))
    has_norm = F.col("low").isNotNull() | F.col("high").isNotNull()
    held = values.groupBy(*KEYS).agg(
        F.bool_or(true(beyond)).alias("against_norm"), F.max(F.when(true(beyond), F.struct(over.alias("d"), F.col("result").alias("v")))).alias("_worst"),
        F.bool_or(has_norm & (F.col("stage") != "PD")).alias("normed"), F.count_if("off_scale").alias("off_scale"),
    )
    both = held.join(met, KEYS, "left")
    status = ladder((true(F.col("against_norm")), CA), (true(F.col("broken")), CA), (F.coalesce("pairs", F.lit(0)) > 0, NV), (true(F.col("normed")), NV), otherwise=ME)
    return both.select(*KEYS, status.alias("_status"), F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), "off_scale", F.when(F.col("against_norm"), F.col("_worst.v")).otherwise(F.col("_far.v")).alias("worst"))


def _placed(rows: DataFrame, params: DataFrame) -> DataFrame:
    """Positions and contours of matched elements, which only the building's axes make comparable."""
    rows = checkpointed(rows)
    pairs, alone = matched(rows)
    columns = ["at", "polygon", "frame", "residual_mm", "label_value"]
    number = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    first = rows.withColumn("_at", number).withColumn("_first", F.min(number).over(W.partitionBy(*KEYS))).where("_at = _first")
    old = first.select(*KEYS, F.col("no").alias("was_no"), *[F.col(c).alias(f"was_{c}") for c in columns])
    both = pairs.join(rows.select(*KEYS, "stage", "no", *columns), [*KEYS, "stage", "no"]).join(old, [*KEYS, "was_no"]).join(F.broadcast(params.drop("kind")), "param_code")
    fits = lambda p: (F.col(f"{p}frame") == BUILDING) & (F.col(f"{p}residual_mm") <= F.col("registration_mm") + SLACK)
    contour = lambda c: (F.size(c) > 2) & (area(F.col(c)) > 0)
    sound = F.when(F.col("measure") == "position", F.col("at").isNotNull() & F.col("was_at").isNotNull()).otherwise(contour("polygon") & contour("was_polygon"))
    able = both.withColumn("able", true(fits("") & fits("was_") & sound))
    drawn = F.col("able") & (F.col("measure") == "shape")
    able = able.withColumn("_p", F.when(drawn, F.col("polygon"))).withColumn("_q", F.when(drawn, F.col("was_polygon")))
    able = able.withColumn("iou", polygon_iou("_p", "_q")).withColumn("far", hausdorff("_p", "_q")).withColumn("shift", F.when(F.col("measure") == "position", _apart("at", "was_at")))
    changed = (F.col("iou") < F.col("iou_min") - SLACK) | (F.col("far") > F.col("hausdorff_mm") + SLACK)
    recounted = F.abs(F.col("label_value") - F.col("was_label_value")) > F.col("tolerance_abs") + SLACK
    bad = F.when(F.col("measure") == "position", F.col("shift") > F.col("tolerance_abs") + SLACK).otherwise(changed | recounted)
    met = able.groupBy(*KEYS).agg(
        F.count_if("able").alias("pairs"), F.bool_or(F.col("able") & true(bad)).alias("broken"),
        F.max(F.when(F.col("able"), F.col("shift"))).alias("_shift"), F.min(F.when(F.col("able"), F.col("iou"))).alias("_iou"),
    )
    stages = rows.groupBy(*KEYS).agg((F.countDistinct("stage") > 1).alias("later"))
    missing = alone.groupBy(*KEYS).agg(F.count("*").alias("alone"))
    every = stages.join(met, KEYS, "left").join(missing, KEYS, "left")
    status = ladder((~F.col("later"), ME), (true(F.col("broken")) | F.col("alone").isNotNull(), CA), (F.coalesce("pairs", F.lit(0)) == 0, NC), otherwise=NV)
    return every.select(*KEYS, status.alias("_status"), F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), F.lit(0).cast("long").alias("off_scale"), F.coalesce("_shift", "_iou").alias("worst"))


@kind("geometry")
def geometry(mentions: DataFrame, params: DataFrame, profiles: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """Findings for what is measured on plans, with pairs compared, off_scale (elements whose sheet isn't to scale) and worst.

    A length, area or count is held against its norm (low, high) and against the earliest stage; a position or contour
    against the same element's of the earliest stage, if both sheets are in the building's axes closely enough.
    """
    rows = checkpointed(elements(mentions, params))
    scalar = _scalar(rows.where(F.col("measure").isin(*SCALARS)), params)
    placed = _placed(rows.where(F.col("measure").isin("position", "shape")), params)
    seen = rows.groupBy(*KEYS).agg(F.bool_or(disputed()).alias("any_disputed"))
    values = subjects(mentions, params, profiles, asked).join(seen, KEYS, "left").join(scalar.unionByName(placed), KEYS, "left")
    status = ladder(
        (F.col("not_applicable"), NA), (true(F.col("any_disputed")), CL), (F.col("any_disputed").isNull(), ME), (F.col("_status").isNull(), NC),
        *[(F.col("_status") == s, s) for s in (CA, ME, NC)], otherwise=NV,
    )
    return values.select(*KEYS, status.alias("status"), F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs"), F.coalesce("off_scale", F.lit(0).cast("long")).alias("off_scale"), F.when(status == CA, F.col("worst")).alias("worst"))
