"""Spatial predicates and graphs of systems over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import kinds
from factloom.kinds.geometry import PARAMS
from factloom.operators import crosschecks, graphs, spatial
from factloom.plans.registry import query
from factloom.sources.tables import table

BOXES = """
    b as (select l_orderkey // 4 as sheet, l_orderkey * 10 + l_linenumber as item, l_returnflag as s, cast(min(l_quantity) as double) as x, cast(any_value(l_linenumber + l_orderkey % 4 * 8) as double) as y from lineitem group by 1, 2, 3),
    r as (select sheet, item, x as x0, y as y0, x + 2 as x1, y + 1 as y1 from b where s = 'R'),
    a as (select sheet, item, x as x0, y as y0, x + 5 as x1, y + 3 as y1 from b where s = 'A')
"""


def _boxes(spark, sf_dir, flag):
    """Sheet, item, and the lower left corner of each item of a kind; four orders are on a sheet."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag)
    return rows.groupBy(F.floor(order / 4).alias("sheet"), (order * 10 + line).alias("item")).agg(F.min("l_quantity").cast("double").alias("x"), F.min((line + order % 4 * 8).cast("double")).alias("y"))


def _shape(*corners):
    return F.array(*[F.array(F.col("x") + dx, F.col("y") + dy) for dx, dy in corners]).alias("shape")


def _box(width, height):
    return _shape((0, 0), (width, 0), (width, height), (0, height))


@query(
    "spatial_predicates",
    f"""
    with {BOXES},
    p as (select r.sheet, r.item, r.x0 >= a.x0 and r.x1 < a.x1 and r.y0 >= a.y0 and r.y1 < a.y1 as is_in,
        sqrt(power(greatest(0, r.x0 - a.x1, a.x0 - r.x1), 2) + power(greatest(0, r.y0 - a.y1, a.y0 - r.y1), 2)) as gap from r join a on a.sheet = r.sheet),
    n as (select r.sheet, r.item, count(*) over (partition by r.sheet) as n from r),
    s as (select n.sheet, n.item, any_value(n) = 1 or coalesce(bool_or(power(o.x0 - r.x0, 2) + power(o.y0 - r.y0, 2) <= 9), false) as ok
        from n join r on r.sheet = n.sheet and r.item = n.item left join r o on o.sheet = r.sheet and o.item <> r.item group by 1, 2),
    g as (select sheet, item, unnest([[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0 + 2, y0], [x0 + 4, y0], [x0, y0 + 2], [x0 + 2, y0 + 2], [x0 + 4, y0 + 2]]) as pt from a),
    h as (select g.sheet, g.item, pt, coalesce(bool_or(power(r.x0 + 1 - pt[1], 2) + power(r.y0 + 0.5 - pt[2], 2) <= 36), false) as ok from g left join r on r.sheet = g.sheet group by 1, 2, 3)
    select 'inside' as predicate, sheet, item, bool_or(is_in) as holds from p group by 1, 2, 3
    union all select 'intersects', sheet, item, bool_or(gap <= 1e-9) from p group by 1, 2, 3
    union all select 'distance', sheet, item, bool_or(gap <= 6 + 1e-9) from p group by 1, 2, 3
    union all select 'max_spacing', sheet, item, ok from s
    union all select 'covers', sheet, item, bool_and(ok) from h group by 1, 2, 3
    """,
)
def spatial_predicates(spark, sf_dir):
    """Items that lie inside, meet, are near another kind's, or one another, and areas that items cover."""
    sheet = ["sheet"]
    subjects = _boxes(spark, sf_dir, "R").select("sheet", "item", _box(2, 1))
    others = _boxes(spark, sf_dir, "A").select("sheet", "item", _box(5, 3))
    asked = spatial.Asked(inside="inside", within={"intersects": 0.0, "distance": 6.0}, spaced=("max_spacing", 3.0), covered=("covers", 6.0, 2.0))
    return spatial.judged(subjects, others, sheet, "item", asked, cell=8.0)


@query(
    "guarded_crossings",
    f"""
    with {BOXES},
    c as (select distinct r.sheet, r.item, unnest([a.x0, a.x1]) as cx, r.y0 + 0.5 as cy, r.x0 from r join a on a.sheet = r.sheet and r.y0 + 0.5 between a.y0 and a.y1),
    k as (select distinct sheet, item, cx, cy from c where cx between x0 and x0 + 12),
    d as (select sheet, x + 1 as dx, y + 0.5 as dy from b where s = 'N'),
    m as (select k.sheet, k.item, cx, coalesce(bool_or(power(dx - cx, 2) + power(dy - cy, 2) <= 9), false) as near from k left join d on d.sheet = k.sheet group by 1, 2, 3)
    select sheet, item, count(*) as crossings, count(*) filter (where not near) as bare from m group by 1, 2
    """,
)
def guarded_crossings(spark, sf_dir):
    """Lines that cross barriers, and how often without a device nearby."""
    lines = _boxes(spark, sf_dir, "R").select("sheet", "item", _shape((0, 0.5), (12, 0.5)))
    barriers = _boxes(spark, sf_dir, "A").select("sheet", _box(5, 3))
    devices = _boxes(spark, sf_dir, "N").select("sheet", _box(2, 1))
    return spatial.guarded_crossings(lines, barriers, devices, ["sheet"], "item", 3.0, cell=8.0)


@query(
    "graph_changes",
    """
    with recursive n0 as (select l_orderkey // 8 as system, case l_returnflag when 'A' then 'PD' else 'RD' end as side, l_orderkey * 10 + l_linenumber as id, min(l_partkey) % 7 as p, min(l_suppkey) % 4 as s from lineitem where l_returnflag <> 'N' group by 1, 2, 3),
    n1 as (select system, side, id, case when s > 0 then 'n' || p end as mark, 'k' || (p % 3) as kind from n0),
    e as (select system, side, lag(id) over (partition by system, side order by id) as u, id as v from n1 qualify u is not null),
    z as (select system, count(distinct mark) filter (where side = 'PD') as na, count(distinct mark) filter (where side = 'RD') as nb from n1 group by 1),
    l as (select system, case when na <= nb then 'PD' else 'RD' end as side from z where na > 0 and nb > 0),
    lv as (select distinct n1.system, kind from n1 join l on n1.system = l.system and n1.side = l.side where mark is not null),
    n as (select n1.*, mark is not null and lv.kind is not null as kept from n1 join l on l.system = n1.system left join lv on lv.system = n1.system and lv.kind = n1.kind),
    d as (select system, side, u, v from e union all select system, side, v, u from e),
    r(system, side, src, node) as (select d.system, d.side, d.u, d.v from d join n on n.system = d.system and n.side = d.side and n.id = d.u and n.kept
        union select r.system, r.side, r.src, d.v from r join n on n.system = r.system and n.side = r.side and n.id = r.node and not n.kept join d on d.system = r.system and d.side = r.side and d.u = r.node),
    k as (select distinct r.system, r.side, a.mark as x, b.mark as y from r join n a on a.system = r.system and a.side = r.side and a.id = r.src join n b on b.system = r.system and b.side = r.side and b.id = r.node and b.kept where a.mark <> b.mark),
    m as (select distinct system, side, mark, kind from n where kept),
    g as (select * from m where not exists (select 1 from m o where o.system = m.system and o.side <> m.side and o.mark = m.mark)),
    nb as (select g.system, g.side, g.mark, g.kind, list(y order by y) as around from g join k on k.system = g.system and k.side = g.side and k.x = g.mark group by 1, 2, 3, 4),
    no as (select *, row_number() over (partition by system, side, kind, around order by mark) as no from nb),
    rn as (select a.system, a.mark as was, b.mark as now from no a join no b on a.system = b.system and a.side = 'PD' and b.side = 'RD' and a.kind = b.kind and a.around = b.around and a.no = b.no),
    k1 as (select distinct k.system, least(coalesce(p.now, x), coalesce(q.now, y)) as a, greatest(coalesce(p.now, x), coalesce(q.now, y)) as b from k left join rn p on p.system = k.system and p.was = x left join rn q on q.system = k.system and q.was = y where side = 'PD' and x < y),
    k2 as (select distinct system, x as a, y as b from k where side = 'RD' and x < y),
    ed as (select g.system, case side when 'PD' then 'rn' else 'an' end as t, mark as v from g where not exists (select 1 from rn where rn.system = g.system and (side = 'PD' and was = mark or side = 'RD' and now = mark))
        union all select system, 'ren', was || '>' || now from rn
        union all select system, 're', a || '-' || b from k1 where not exists (select 1 from k2 where k2.system = k1.system and k2.a = k1.a and k2.b = k1.b)
        union all select system, 'ae', a || '-' || b from k2 where not exists (select 1 from k1 where k1.system = k2.system and k2.a = k1.a and k2.b = k1.b)),
    f as (select l.system, coalesce(list(v order by v) filter (where t = 'rn'), []) as removed_nodes, coalesce(list(v order by v) filter (where t = 'an'), []) as added_nodes, coalesce(list(v order by v) filter (where t = 'ren'), []) as renamed,
        coalesce(list(v order by v) filter (where t = 're'), []) as removed_edges, coalesce(list(v order by v) filter (where t = 'ae'), []) as added_edges from l left join ed on ed.system = l.system group by 1)
    select system, array_to_string(removed_nodes, ' ') as removed_nodes, array_to_string(added_nodes, ' ') as added_nodes, array_to_string(renamed, ' ') as renamed, array_to_string(removed_edges, ' ') as removed_edges,
        array_to_string(added_edges, ' ') as added_edges, 3 * len(removed_nodes) + len(added_nodes) + len(renamed) + 2 * len(removed_edges) + len(added_edges) as cost, len(removed_nodes) + len(removed_edges) + len(renamed) > 0 as changed from f
    """,
    casts={"cost": "integer"},
)
def graph_changes(spark, sf_dir):
    """What came, went and was renamed in each system's graph between two stages."""
    part, supplier = F.min("l_partkey") % 7, F.min("l_suppkey") % 4
    side = F.when(F.col("l_returnflag") == "A", "PD").otherwise("RD")
    nodes = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy(F.floor(F.col("l_orderkey") / 8).alias("system"), side.alias("side"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        F.when(supplier > 0, F.concat(F.lit("N "), part.cast("string"))).alias("mark"), F.concat(F.lit("k"), (part % 3).cast("string")).alias("kind")
    )
    edges = nodes.select("system", "side", F.lag("id").over(W.partitionBy("system", "side").orderBy("id")).alias("u"), F.col("id").alias("v")).where("u is not null")
    found = graphs.compared(nodes, edges, ["system"])
    lists = ("removed_nodes", "added_nodes", "renamed", "removed_edges", "added_edges")
    return found.select("system", *[F.array_join(c, " ").alias(c) for c in lists], "cost", "changed")


@query(
    "totals_and_rows",
    """
    with r as (select l_orderkey // 8 as object_id, l_returnflag as stage, l_suppkey % 3 as table_id, sum(l_quantity) as counted from lineitem group by 1, 2, 3),
    t as (select l_orderkey // 8 as object_id, l_returnflag as stage, l_suppkey % 3 as table_id, cast(round(sum(case when l_linenumber < 7 then l_quantity else l_quantity + 3 end)) as double) as total from lineitem group by 1, 2, 3),
    w as (select object_id, stage, sum(counted) as counted from r group by 1, 2),
    s as (select l_orderkey // 8 as object_id, l_returnflag as stage, l_linenumber as place, sum(l_quantity) * 7 as value from lineitem group by 1, 2, 3),
    a as (select object_id, stage, 'explication_total' as "check", cast(table_id as varchar) as place, total as stated, counted from t join r using (object_id, stage, table_id)
        union all select object_id, stage, 'tep_explication', cast(place as varchar), value, counted from s join w using (object_id, stage))
    select * from a where abs(stated - counted) > greatest(1.0, greatest(abs(stated), abs(counted)) * 2 / 100) + 1e-9
    """,
)
def totals_and_rows(spark, sf_dir):
    """Room lists whose totals, and totals elsewhere, aren't what the rows add up to."""
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.floor(F.col("l_orderkey") / 8).alias("object_id"), F.col("l_returnflag").alias("stage")]
    names, list_no = ["object_id", "stage"], (F.col("l_suppkey") % 3).alias("table_id")
    rows = lines.select(*keys, list_no, F.col("l_quantity").alias("area"))
    totals = lines.groupBy(*keys, list_no).agg(F.round(F.sum(F.when(F.col("l_linenumber") < 7, F.col("l_quantity")).otherwise(F.col("l_quantity") + 3))).alias("total"))
    stated = lines.groupBy(*keys, F.col("l_linenumber").alias("place")).agg((F.sum("l_quantity") * 7).alias("value"))
    return crosschecks.totals_and_rows(rows, totals, stated, names, 1.0, 2.0)


@query(
    "schedule_and_plans",
    """
    with s as (select l_orderkey // 8 as object_id, 'd' || (l_partkey % 5) as mark, l_orderkey * 10 + l_linenumber as row_id, min(l_quantity) * 20 as width from lineitem where l_returnflag = 'A' group by 1, 2, 3),
    o as (select l_orderkey // 8 as object_id, 'd' || (l_partkey % 5) as mark, case when l_linenumber < 6 then l_quantity * 20 end as measured from lineitem where l_returnflag = 'R')
    select object_id, mark, row_id, width, count(*) as others, max(abs(measured - width)) as most from s join o using (object_id, mark)
    where abs(measured - width) > greatest(30.0, greatest(measured, width) * 5 / 100) + 1e-9 group by 1, 2, 3, 4
    """,
)
def schedule_and_plans(spark, sf_dir):
    """Openings whose width on plans isn't the schedule's."""
    lines = table(spark, sf_dir, "lineitem")
    key = F.floor(F.col("l_orderkey") / 8).alias("object_id")
    number = (F.col("l_partkey") % 5).cast("string")
    schedule = lines.where("l_returnflag = 'A'").groupBy(key, F.concat(F.lit("D "), number).alias("mark"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id")).agg((F.min("l_quantity") * 20).alias("width"))
    openings = lines.where("l_returnflag = 'R'").select(key, F.concat(F.lit("d-"), number).alias("mark"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity") * 20).alias("measured"))
    return crosschecks.schedule_and_plans(schedule, openings, ["object_id"], 30.0, 5.0)


@query(
    "unguarded_walls",
    f"""
    with {BOXES},
    f as (select sheet, item, s, x * 2 + 100 as x, y * 2 as y, item % 3 as floor, item % 2 as sheet_no, item % 7 < 6 as fits from b),
    c as (select distinct r.sheet, r.floor, r.sheet_no, r.item, a.x as cx, r.y + 1 as cy from f r join f a on a.sheet = r.sheet and a.floor = r.floor and r.s = 'R' and a.s = 'A' and r.fits and a.fits
        and a.x between r.x and r.x + 24 and r.y + 1 between a.y and a.y + 6)
    select sheet as object_id, sheet_no as sheet, item as route, cx as x, cy as y from c
    where not exists (select 1 from f d where d.s = 'N' and d.sheet = c.sheet and d.sheet_no = c.sheet_no and sqrt(power(d.x - cx, 2) + power(d.y - cy, 2)) <= 9 + 1e-9)
    """,
)
def unguarded_walls(spark, sf_dir):
    """Where routes cross walls of another discipline's sheet of the floor without a device nearby."""
    frame = F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0, 100.0, 0.0))).alias("frame")
    item = F.col("item")
    common = [F.col("sheet").alias("object_id"), (item % 3).alias("floor"), (item % 2).alias("sheet"), frame, F.when(item % 7 < 6, 1.0).otherwise(9.0).alias("residual_mm")]
    line = lambda *corners: _shape(*corners).alias("points")
    walls = _boxes(spark, sf_dir, "A").select(*common, line((0, 0), (0, 3)))
    routes = _boxes(spark, sf_dir, "R").select(*common, item.alias("route"), line((0, 0.5), (12, 0.5)))
    devices = _boxes(spark, sf_dir, "N").select(*common, F.array("x", "y").alias("at"))
    return crosschecks.unguarded_walls(walls, routes, devices, ["object_id"], 9.0, 2.0, cell=16.0)


@query(
    "kind_geometry",
    """
    with m as (select l_orderkey // 4 as object_id, l_partkey % 6 as p, case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as st, l_suppkey % 3 as k, cast(min(l_quantity) as double) as x, cast(min(l_linenumber) as double) as y,
        max(l_discount) > 0.098 as disputed, max(l_tax) > 0.07 as odd from lineitem group by 1, 2, 3, 4),
    v as (select *, case p when 0 then x when 1 then case when not odd then x * 100 end when 2 then x * 100 when 4 then x * y end as result, min(st) over (partition by object_id, p) as first from m),
    w as (select *, min(st) over (partition by object_id, p) as fst from v where result is not null),
    g as (select object_id, p, st, any_value(fst) as fst, sum(result) as s, min(result) as lo, max(result) as hi from w group by 1, 2, 3),
    pr as (select b.object_id, b.p, case b.p when 0 then a.s when 1 then a.lo else a.hi end as base, case b.p when 0 then b.s when 1 then b.lo else b.hi end as value from g a join g b on a.object_id = b.object_id and a.p = b.p and a.st = a.fst and b.st > b.fst and b.p in (0, 1, 4)
        union all select b.object_id, b.p, a.result, b.result from w a join w b on a.object_id = b.object_id and a.p = b.p and a.k = b.k and a.st = a.fst and b.st > b.fst and b.p = 2
        union all select b.object_id, b.p, a.lo, b.lo from g a join g b on a.object_id = b.object_id and a.p = b.p and a.st = a.fst and b.st > b.fst and b.p = 2
            where not exists (select 1 from w x join w y on x.object_id = y.object_id and x.p = y.p and x.k = y.k and x.st = x.fst where y.object_id = b.object_id and y.p = b.p and y.st = b.st)),
    s as (select object_id, p, count(*) as pairs, max(abs(value - base)) filter (where base - value > greatest(2.0, abs(base) * 10 / 100) + 1e-9) as far, arg_max(value, abs(value - base) * 1e6 + value) filter (where base - value > greatest(2.0, abs(base) * 10 / 100) + 1e-9) as worst from pr group by 1, 2),
    n as (select object_id, p, min(result) filter (where result < 300 - 1e-9) as under, bool_or(st > 1) as late from w where p = 1 group by 1, 2),
    pl as (select b.object_id, b.p, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) as shift, greatest(0, 6 - abs(a.x - b.x)) * greatest(0, 3 - abs(a.y - b.y)) as shared, not a.odd and not b.odd as able from v a join v b on a.object_id = b.object_id and a.p = b.p and a.k = b.k and a.st = a.first and b.st > b.first and b.p in (3, 5)),
    lo as (select distinct a.object_id, a.p, a.k, o.st from v a join v o on a.object_id = o.object_id and a.p = o.p and a.st = a.first and o.st > o.first and a.p in (3, 5) where not exists (select 1 from v b where b.object_id = a.object_id and b.p = a.p and b.k = a.k and b.st = o.st)),
    pq as (select object_id, p, count(*) filter (where able) as pairs, bool_or(able and case p when 3 then shift > 8 + 1e-9 else shared / (36 - shared) < 0.4 - 1e-9 end) as broken, case p when 3 then max(shift) filter (where able) else min(shared / (36 - shared)) filter (where able) end as worst from pl group by 1, 2),
    k as (select object_id, p, bool_or(disputed) as disputed, count(distinct st) as stages from v group by 1, 2),
    f as (select k.object_id, k.p, disputed, stages, coalesce(s.pairs, pq.pairs, 0) as pairs, far, s.worst as sw, under, late, pq.broken, pq.worst as pw, exists (select 1 from lo where lo.object_id = k.object_id and lo.p = k.p) as alone,
        exists (select 1 from w where w.object_id = k.object_id and w.p = k.p) as has from k left join s using (object_id, p) left join n using (object_id, p) left join pq using (object_id, p)),
    t as (select *, case when disputed then 'CLARIFICATION_REQUIRED' when p in (3, 5) and stages < 2 then 'MISSING_EVIDENCE' when p in (3, 5) and (alone or coalesce(broken, false)) then 'CANDIDATE' when p in (3, 5) and pairs = 0 then 'NOT_COMPARABLE' when p in (3, 5) then 'NEGATIVE_VERIFIED'
        when not has then 'NOT_COMPARABLE' when under is not null then 'CANDIDATE' when far is not null then 'CANDIDATE' when pairs > 0 then 'NEGATIVE_VERIFIED' when p = 1 and late then 'NEGATIVE_VERIFIED' else 'MISSING_EVIDENCE' end as status from f)
    select object_id, 'P' || p as param_code, status, pairs, cast(0 as bigint) as off_scale, round(case when status = 'CANDIDATE' then case when p in (3, 5) then pw when under is not null then under else sw end end, 6) as worst from t
    """,
)
def kind_geometry(spark, sf_dir):
    """Findings for counts, lengths, areas, positions and contours of marked elements."""
    p, x, y = F.col("l_partkey") % 6, F.min("l_quantity").cast("double"), F.min("l_linenumber").cast("double")
    stage = F.when(F.col("l_returnflag") == "A", "PD").when(F.col("l_returnflag") == "N", "RD").otherwise("ID")
    odd = F.max("l_tax") > 0.07
    rows = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 4).alias("object_id"), p.alias("p"), stage.alias("stage"), (F.col("l_suppkey") % 3).alias("k")).agg(
        x.alias("x"), y.alias("y"), F.when(F.max("l_discount") > 0.098, "CONFLICT").otherwise("CURRENT").alias("role"), odd.alias("odd")
    )
    none, mm = F.lit(None).cast("double"), F.lit(1000.0)
    box = F.array(*[F.array(F.col("x") * mm + dx, F.col("y") * mm + dy) for dx, dy in ((0, 0), (6000, 0), (6000, 3000), (0, 3000))])
    plot = F.array(*[F.array(dx, dy) for dx, dy in ((F.lit(0.0), F.lit(0.0)), (F.col("x") * mm, F.lit(0.0)), (F.col("x") * mm, F.col("y") * mm), (F.lit(0.0), F.col("y") * mm))])
    mentions = rows.select(
        "object_id", F.concat(F.lit("P"), F.col("p").cast("string")).alias("param_code"), "stage", "role", F.lit(0.9).alias("confidence"), F.lit("f").alias("file_id"), F.lit(1).alias("page"),
        F.concat(F.lit("к "), F.col("k").cast("string")).alias("key"), F.array(F.col("x") * mm, F.col("y") * mm).alias("at"),
        F.when(F.col("p") == 5, box).when(F.col("p") == 4, plot).alias("polygon"), F.when(F.col("p") == 0, F.col("x")).alias("value"), F.when(F.col("p") == 2, F.col("x") * 100).alias("label_value"),
        F.when(F.col("p") == 1, F.col("x") * 100).alias("measured_value"), F.lit("geometry").alias("by"), F.when((F.col("p") == 3) & F.col("odd"), "sheet").otherwise("bld").alias("frame"),
        F.when((F.col("p") == 5) & F.col("odd"), 90.0).otherwise(1.0).alias("residual_mm"), F.lit(100.0).alias("scale_n"), F.when(F.col("odd"), 9.0).otherwise(1.0).alias("scale_spread_pct"),
    )
    settings = [("count", "sum", None), ("length", "min", 300.0), ("length", "each", None), ("position", "each", None), ("area", "max", None), ("shape", "each", None)]
    params = [(f"P{i}", "geometry", measure, how, "decrease", 8000.0 if i == 3 else 2.0, 10.0, 5.0, 2.0, 0.0, 10.0, 0.4, 1e9, low, None) for i, (measure, how, low) in enumerate(settings)]
    found = kinds.evaluate("geometry", mentions, spark.createDataFrame(params, PARAMS))
    worst = F.when(F.col("param_code") == "P3", F.col("worst") / mm).otherwise(F.col("worst"))
    return found.withColumn("worst", F.round(worst, 6))
