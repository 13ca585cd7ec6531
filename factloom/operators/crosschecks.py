"""Checks between documents of one stage: totals against rows, schedules against plans, routes against walls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.compare import SLACK
from factloom.operators.geometry import crossings
from factloom.operators.spatial import meeting
from factloom.operators.stacks import written_key


def agree(a: Column, b: Column, absolute: float, percent: float) -> Column:
    """Whether two values are as near as the larger of both tolerances lets them be."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.greatest(F.abs(a), F.abs(b)) * percent / 100) + SLACK


def totals_and_rows(rows: DataFrame, totals: DataFrame, stated: DataFrame, keys: list[str], absolute: float, percent: float) -> DataFrame:
    """keys, check, place, stated and counted where a total isn't what its rows add up to.

    ``rows`` (keys, table_id, area) are those of room lists, ``totals`` (keys, table_id, total) their own totals, which
    the first check holds against them, ``stated`` (keys, place, value) what is said elsewhere of all lists of the keys.
    Keys without any list have nothing to hold against.
    """
    sums = rows.groupBy(*keys, "table_id").agg(F.sum("area").alias("counted"))
    own = totals.where("total is not null").join(sums, [*keys, "table_id"], "left").withColumn("counted", F.coalesce("counted", F.lit(0.0)))
    own = own.select(*keys, F.lit("explication_total").alias("check"), F.col("table_id").cast("string").alias("place"), F.col("total").alias("stated"), "counted")
    whole = sums.groupBy(*keys).agg(F.sum("counted").alias("counted"))
    said = stated.join(whole, keys).select(*keys, F.lit("tep_explication").alias("check"), F.col("place").cast("string").alias("place"), F.col("value").alias("stated"), "counted")
    return own.unionByName(said).where(~agree(F.col("stated"), F.col("counted"), absolute, percent))


def schedule_and_plans(schedule: DataFrame, openings: DataFrame, keys: list[str], absolute: float, percent: float) -> DataFrame:
    """keys, mark, row_id, width and others: openings whose width on plans isn't that of their row in the schedule."""
    mark = lambda df: df.withColumn("mark", written_key(F.col("mark")))
    met = mark(schedule).join(mark(openings).where("measured is not null").select(*keys, "mark", "measured"), [*keys, "mark"])
    apart = met.where(~agree(F.col("measured"), F.col("width"), absolute, percent))
    return apart.groupBy(*keys, "mark", "row_id", "width").agg(F.count("*").alias("others"), F.max(F.abs(F.col("measured") - F.col("width"))).alias("most"))


def in_building(points: Column, frame: Column) -> Column:
    """Points of a sheet in the axes of the building: frame a, b, c, d, e, f gives x' = ax + cy + e and y' = bx + dy + f."""
    return F.transform(points, lambda p: F.array(frame[0] * p[0] + frame[2] * p[1] + frame[4], frame[1] * p[0] + frame[3] * p[1] + frame[5]))


def unguarded_walls(walls: DataFrame, routes: DataFrame, devices: DataFrame, keys: list[str], radius: float, residual: float, cell: float) -> DataFrame:
    """keys, route and the places (x, y) where a route crosses a wall of its floor with none of its sheet's devices near.

    Walls (points) and routes (sheet, route, points) have floor, frame and residual_mm, devices (sheet, at) have frame.
    Sheets without a floor or a frame, or whose frame is off by more than ``residual``, can't be laid on one another.
    """
    fit = lambda df: df.where(F.col("floor").isNotNull() & F.col("frame").isNotNull() & (F.col("residual_mm") <= residual + SLACK))
    leg = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.array(c[i - 1], c[i]))
    legs = lambda df, *names: df.where(F.size("points") > 1).select(*keys, "floor", *names, F.explode(leg(in_building(F.col("points"), F.col("frame")))).alias("shape"))
    met = meeting(legs(fit(routes), "sheet", "route"), legs(fit(walls)).withColumnRenamed("shape", "other"), [*keys, "floor"], 0.0, cell)
    at = met.select(*keys, "sheet", "route", F.explode(crossings(F.col("shape"), F.col("other"))).alias("at")).distinct().select(*keys, "sheet", "route", F.array("at").alias("shape"))
    near = devices.where("frame is not null").select(*keys, "sheet", in_building(F.array("at"), F.col("frame")).alias("other"))
    apart = lambda i: F.pow(F.col("shape")[0][i] - F.col("other")[0][i], 2)
    guarded = meeting(at, near, [*keys, "sheet"], radius, cell).where(F.sqrt(apart(0) + apart(1)) <= radius + SLACK).select(*keys, "sheet", "route", F.to_json("shape").alias("_at")).distinct()
    bare = at.withColumn("_at", F.to_json("shape")).join(guarded, [*keys, "sheet", "route", "_at"], "left_anti")
    return bare.select(*keys, "sheet", "route", F.col("shape")[0][0].alias("x"), F.col("shape")[0][1].alias("y"))
