"""Geometry kinds: areas, containment, shifts, spacing and graphs, over shapes drawn from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.geometry import apply_frame, area, distance_to_contour, hausdorff, inside, polygon_iou, related
from factloom.plans.registry import query
from factloom.sources.tables import table


def _rooms(spark, sf_dir, spread=False):
    """A trapezium for each part: size and price give its sides; a small file is one task's unless it is spread."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    w, h = F.col("p_size").cast("double"), (F.col("p_retailprice") % 50) + 1
    points = ((F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w / 2, h), (F.lit(0.0), h))
    polygon = F.array(*[F.array(x, y) for x, y in points])
    return (parts.repartition("p_partkey") if spread else parts).select("p_partkey", w.alias("w"), h.alias("h"), polygon.alias("polygon"))


@query("polygon_area", "select p_partkey, round((p_size + p_size / 2.0) / 2 * ((p_retailprice % 50) + 1), 6) as area from part")
def polygon_area(spark, sf_dir):
    return _rooms(spark, sf_dir).select("p_partkey", F.round(area(F.col("polygon")), 6).alias("area"))


@query(
    "point_in_polygon",
    "select p_partkey, 5.5 < p_size - (p_size - p_size / 2.0) * 3.25 / ((p_retailprice % 50) + 1) and 3.25 < (p_retailprice % 50) + 1 as holds from part",
)
def point_in_polygon(spark, sf_dir):
    return _rooms(spark, sf_dir).select("p_partkey", inside(F.col("polygon"), F.lit(5.5), F.lit(3.25)).alias("holds"))


@query("shape_change")
def shape_change(spark, sf_dir):
    """How far a contour moved and how far the point (5, 3) is from its edge."""
    moved = F.transform("polygon", lambda p: F.array(*apply_frame(p[0], p[1], [1.0, 0.0, 2.0, 0.0, 1.0, -1.0])))
    rooms = _rooms(spark, sf_dir, spread=True)
    return rooms.select("p_partkey", hausdorff(F.col("polygon"), moved).alias("moved"), distance_to_contour(F.lit(5.0), F.lit(3.0), F.col("polygon")).alias("edge"))


@query(
    "position_shift",
    """
    with a as (select l_orderkey, l_linenumber, avg(l_quantity) as x, avg(l_discount) * 100 as y from lineitem where l_returnflag = 'A' group by 1, 2),
    b as (select l_orderkey, l_linenumber, avg(l_quantity) as x, avg(l_discount) * 100 as y from lineitem where l_returnflag = 'R' group by 1, 2)
    select a.l_orderkey, a.l_linenumber, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) as shift from a join b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber
    where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) > 20
    """,
)
def position_shift(spark, sf_dir):
    """Keyed elements that moved further than the tolerance."""
    keys = ["l_orderkey", "l_linenumber"]
    side = lambda s, n: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == s).groupBy(*keys).agg(F.avg("l_quantity").alias(f"x{n}"), (F.avg("l_discount") * 100).alias(f"y{n}"))
    shift = F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2))
    return side("A", "a").join(side("R", "b"), keys).select(*keys, shift.alias("shift")).where("shift > 20").withColumn("shift", F.round("shift", 6))


@query(
    "spacing",
    """
    select l_orderkey, round(max(gap), 6) as widest, count(*) as gaps from (select l_orderkey, l_quantity - lag(l_quantity) over (partition by l_orderkey order by l_quantity, l_linenumber, l_partkey) as gap from lineitem) t
    where gap is not null group by 1 having max(gap) > 30
    """,
)
def spacing(spark, sf_dir):
    """Elements in a row that stand further apart than the norm."""
    before = F.lag("l_quantity").over(W.partitionBy("l_orderkey").orderBy("l_quantity", "l_linenumber", "l_partkey"))
    gaps = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_quantity") - before).alias("gap")).where("gap is not null")
    return gaps.groupBy("l_orderkey").agg(F.round(F.max("gap"), 6).alias("widest"), F.count("*").alias("gaps")).where("widest > 30")


@query(
    "graph_diff",
    """
    with e as (select distinct l_orderkey % 200 as system, l_returnflag as stage, least(l_linenumber, l_suppkey % 9) as a, greatest(l_linenumber, l_suppkey % 9) as b from lineitem),
    x as (select system, a, b from e where stage = 'A'), y as (select system, a, b from e where stage = 'R')
    select coalesce(x.system, y.system) as system, count(*) filter (where y.system is null) as removed, count(*) filter (where x.system is null) as added,
           count(*) filter (where x.system is not null and y.system is not null) as kept
    from x full outer join y on x.system = y.system and x.a = y.a and x.b = y.b group by 1
    """,
)
def graph_diff(spark, sf_dir):
    """Edges of a system's graph that came or went between two stages: its edit cost."""
    a, b = F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 9
    e = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("system"), "l_returnflag", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    keys = ["system", "a", "b"]
    x = e.where("l_returnflag = 'A'").select(*keys, F.lit(1).alias("x"))
    y = e.where("l_returnflag = 'R'").select(*keys, F.lit(1).alias("y"))
    both = x.join(y, keys, "full_outer")
    return both.groupBy("system").agg(F.count_if(F.col("y").isNull()).alias("removed"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("kept"))


@query(
    "symbols_per_page",
    """
    with pages as (select distinct l_orderkey, l_linenumber from lineitem), s as (select l_orderkey, l_linenumber, count(*) as n from lineitem where l_quantity > 40 group by 1, 2)
    select pages.l_orderkey, pages.l_linenumber, coalesce(n, 0) as symbols from pages left join s on s.l_orderkey = pages.l_orderkey and s.l_linenumber = pages.l_linenumber
    """,
)
def symbols_per_page(spark, sf_dir):
    """Symbols counted on every page seen, also those with none."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.count_if(F.col("l_quantity") > 40).alias("symbols"))


@query(
    "relation_holds",
    f"""
    with b as (select l_orderkey as sheet, l_linenumber as item, l_returnflag as s, l_quantity as x, l_linenumber as y from lineitem)
    select a.sheet, a.item, bool_or(sqrt(power(greatest(0, a.x - b.x - 2, b.x - a.x - 2), 2) + power(greatest(0, a.y - b.y - 1, b.y - a.y - 1), 2)) <= 6 + 1e-9) as holds
    from b a join b on a.sheet = b.sheet and a.s = 'R' and b.s = 'A' group by 1, 2
    """,
)
def relation_holds(spark, sf_dir):
    """Elements of one kind that have one of another within reach on their sheet."""
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("item"), "l_returnflag", F.array(x, y, x + 2, y + 1).alias("box"))
    return related(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), ["sheet"], "item", "distance", 6.0)


@query(
    "polygon_overlap",
    """
    with b as (select l_orderkey as k, l_returnflag as s, min(l_quantity) as x, min(l_linenumber) as y from lineitem group by 1, 2),
    p as (select a.k, greatest(0, 12 - abs(a.x - b.x)) * greatest(0, 4 - abs(a.y - b.y)) as shared from b a join b on a.k = b.k and a.s = 'A' and b.s = 'R')
    select k, round(shared / (96 - shared), 6) as iou from p
    """,
)
def polygon_overlap(spark, sf_dir):
    """How much the contours of two stages share."""
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), "l_returnflag").agg(F.min("l_quantity").alias("x"), F.min("l_linenumber").cast("double").alias("y"))
    corner = lambda dx, dy: F.array(F.col("x") + dx, F.col("y") + dy)
    contour = F.array(corner(0, 0), corner(12, 0), corner(12, 4), corner(0, 4))
    side = lambda s, name: b.where(F.col("l_returnflag") == s).select("k", contour.alias(name))
    return side("A", "p").join(side("R", "q"), "k").select("k", F.round(polygon_iou("p", "q"), 6).alias("iou"))
