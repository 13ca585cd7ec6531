"""Comparison kinds beyond the numeric ones, cross-document consistency, and mentions read from text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions import extract
from factloom.operators.compare import ladder
from factloom.operators.picks import first_per
from factloom.plans.registry import query
from factloom.sources.tables import table

#: A sentence for each part, in the words of a specification.
SENTENCE_SQL = """
(select p_partkey, 'Wall ' || p_name || ': width at least ' || p_size || ',5 m, height ' || (p_size % 7) || ' m; exits: ' || (p_size % 4) || case when p_size % 3 = 0 then ', without alarm' else ', alarm' end ||
   case when p_size % 5 = 0 then '. Door opens outward' when p_size % 5 = 1 then '. Door opens inward' else '' end || '. Class Е' || (p_size % 3) || '. Brick - ' || p_size || ' mm; wool - 50 mm' as s, p_size from part)
"""


def sentences(spark, sf_dir):
    size = F.col("p_size").cast("string")
    mod = lambda n: (F.col("p_size") % n).cast("string")
    alarm = F.when(F.col("p_size") % 3 == 0, ", without alarm").otherwise(", alarm")
    door = F.when(F.col("p_size") % 5 == 0, ". Door opens outward").when(F.col("p_size") % 5 == 1, ". Door opens inward").otherwise("")
    s = F.concat(
        F.lit("Wall "), "p_name", F.lit(": width at least "), size, F.lit(",5 m, height "), mod(7), F.lit(" m; exits: "), mod(4), alarm, door,
        F.lit(". Class Е"), mod(3), F.lit(". Brick - "), size, F.lit(" mm; wool - 50 mm"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s"), "p_size")


@query(
    "mention_quantities",
    f"""
    select p_partkey, i, case i when 0 then p_size + 0.5 when 1 then p_size % 7 when 2 then p_size else 50.0 end as num, case when i < 2 then 'm' else 'mm' end as unit, case i when 0 then 'MIN' end as qualifier
    from {SENTENCE_SQL} t cross join range(4) r(i)
    """,
    {"i": "integer", "num": "double"},
)
def mention_quantities(spark, sf_dir):
    """Values with units and qualifiers, a row each."""
    found = F.posexplode(extract.quantities(F.col("s"), ["m", "mm", "kg"])).alias("i", "q")
    return sentences(spark, sf_dir).select("p_partkey", found).select("p_partkey", "i", "q.num", "q.unit", "q.qualifier")


@query(
    "mention_facts",
    f"""
    select p_partkey, p_size % 4 as exits, case when p_size % 3 = 0 then 'ABSENT' else 'PRESENT' end as alarm, case p_size % 5 when 0 then 'OUT' when 1 then 'IN' end as door, 'E' || (p_size % 3) as class,
           2 as n_layers, cast(p_size as double) as first_mm from {SENTENCE_SQL} t
    """,
    {"exits": "bigint"},
)
def mention_facts(spark, sf_dir):
    """Counts, presence, direction, class and layers of one text."""
    s = F.col("s")
    stack = extract.layers(s)
    return sentences(spark, sf_dir).select(
        "p_partkey",
        extract.counts(s, ["exits", "doors"])[0]["n"].alias("exits"),
        extract.presence(s, "alarm").alias("alarm"),
        extract.direction(s).alias("door"),
        extract.classes(s, ["E0", "E1", "E2"])[0].alias("class"),
        F.size(stack).alias("n_layers"),
        stack[0]["t"].alias("first_mm"),
    )


@query(
    "evaluate_direction",
    """
    with d as (select l_orderkey as building, l_linenumber as mark, l_returnflag as stage, case when min(l_quantity) < 17 then 'OUT' when min(l_quantity) < 34 then 'IN' else 'SLIDING' end as dir, bool_or(l_discount > 0.09) as exempt from lineitem group by 1, 2, 3),
    g as (select building, min(dir) as dir from d where stage = 'A' and mark = 1 group by 1),
    p as (select r.building, r.mark, coalesce(a.dir, g.dir) as base, r.dir as actual, r.exempt, a.dir is not null as own from d r left join d a on a.building = r.building and a.mark = r.mark and a.stage = 'A'
          left join g on g.building = r.building where r.stage = 'R')
    select building, mark, base, actual, case when base is null then 'MISSING_EVIDENCE' when base = 'OUT' and actual <> 'OUT' and not exempt then 'CANDIDATE' when base = 'OUT' and actual <> 'OUT' then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status from p
    """,
)
def evaluate_direction(spark, sf_dir):
    """Doors by mark and building against the design, else against its general statement; an exemption makes it incomparable."""
    low = F.min("l_quantity")
    turn = F.when(low < 17, "OUT").when(low < 34, "IN").otherwise("SLIDING")
    keys = [F.col("l_orderkey").alias("building"), F.col("l_linenumber").alias("mark"), "l_returnflag"]
    doors = table(spark, sf_dir, "lineitem").groupBy(*keys).agg(turn.alias("dir"), F.bool_or(F.col("l_discount") > 0.09).alias("exempt"))
    design = doors.where("l_returnflag = 'A'").select("building", "mark", F.col("dir").alias("own"))
    general = design.where("mark = 1").select("building", F.col("own").alias("general"))
    pairs = doors.where("l_returnflag = 'R'").join(design, ["building", "mark"], "left").join(general, "building", "left")
    pairs = pairs.select("building", "mark", F.coalesce("own", "general").alias("base"), F.col("dir").alias("actual"), "exempt")
    turned = (F.col("base") == "OUT") & (F.col("actual") != "OUT")
    status = ladder((F.col("base").isNull(), "MISSING_EVIDENCE"), (turned & ~F.col("exempt"), "CANDIDATE"), (turned, "NOT_COMPARABLE"), otherwise="NEGATIVE_VERIFIED")
    return pairs.select("building", "mark", "base", "actual", status.alias("status"))


@query(
    "evaluate_schedule",
    """
    with s as (select l_orderkey as k, l_linenumber as work, l_returnflag as stage, sum(l_quantity) as days, min(l_shipdate) as start, bool_or(l_discount >= 0.08) as critical from lineitem group by 1, 2, 3),
    p as (select a.k, a.work, a.days as planned, b.days as actual, a.critical, a.start as sa, b.start as sb from s a join s b on a.k = b.k and a.work = b.work and a.stage = 'A' and b.stage = 'R'),
    i as (select distinct x.k from p x join p y on x.k = y.k and x.work < y.work and ((x.sa < y.sa and x.sb > y.sb) or (x.sa > y.sa and x.sb < y.sb))),
    o as (select p.k, count(*) as pairs, bool_or(critical and actual > planned * 1.2 + 1e-9) as late, bool_or(actual > planned * 1.2 + 1e-9) as suspect from p group by 1)
    select o.k, pairs, case when late or i.k is not null then 'CANDIDATE' when suspect then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status from o left join i on i.k = o.k
    """,
)
def evaluate_schedule(spark, sf_dir):
    """Durations of critical works and the order of works; a late work of unknown weight is only a suspicion."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("work"), "l_returnflag").agg(
        F.sum("l_quantity").alias("days"), F.min("l_shipdate").alias("start"), F.bool_or(F.col("l_discount") >= 0.08).alias("critical")
    )
    a = s.where("l_returnflag = 'A'").select("k", "work", F.col("days").alias("planned"), F.col("start").alias("sa"), "critical")
    b = s.where("l_returnflag = 'R'").select("k", "work", F.col("days").alias("actual"), F.col("start").alias("sb"))
    p = a.join(b, ["k", "work"])
    turned = "x.k = y.k and x.work < y.work and ((x.sa < y.sa and x.sb > y.sb) or (x.sa > y.sa and x.sb < y.sb))"
    inverted = p.alias("x").join(p.alias("y"), F.expr(turned)).select("x.k").distinct().withColumn("inverted", F.lit(True))
    over = F.col("actual") > F.col("planned") * 1.2 + 1e-9
    o = p.groupBy("k").agg(F.count("*").alias("pairs"), F.bool_or(F.col("critical") & over).alias("late"), F.bool_or(over).alias("suspect"))
    status = ladder((F.col("late") | F.coalesce("inverted", F.lit(False)), "CANDIDATE"), (F.col("suspect"), "NOT_COMPARABLE"), otherwise="NEGATIVE_VERIFIED")
    return o.join(inverted, "k", "left").select("k", "pairs", status.alias("status"))


@query(
    "document_requirements",
    """
    with w as (select l_orderkey as k, count(*) filter (where l_returnflag = 'A') as works, count(*) filter (where l_returnflag = 'R') as acts, min(l_quantity) filter (where l_returnflag = 'A') as need,
                 min(l_quantity) filter (where l_returnflag = 'R') as have, bool_or(l_returnflag = 'R' and l_tax = 0) as empty_requisite from lineitem group by 1)
    select k, works, acts, case when works = 0 then 'NOT_APPLICABLE' when coalesce(have < need - 1e-9, false) or empty_requisite then 'CANDIDATE' when acts = 0 then 'MISSING_EVIDENCE' else 'NEGATIVE_VERIFIED' end as status from w
    """,
)
def document_requirements(spark, sf_dir):
    """Works need acts: weaker sections and empty requisites are findings, a missing act is a gap."""
    work, act = F.col("l_returnflag") == "A", F.col("l_returnflag") == "R"
    w = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count_if(work).alias("works"), F.count_if(act).alias("acts"), F.min(F.when(work, F.col("l_quantity"))).alias("need"),
        F.min(F.when(act, F.col("l_quantity"))).alias("have"), F.bool_or(act & (F.col("l_tax") == 0)).alias("empty_requisite"),
    )
    weaker = F.coalesce(F.col("have") < F.col("need") - 1e-9, F.lit(False))
    status = ladder((F.col("works") == 0, "NOT_APPLICABLE"), (weaker | F.col("empty_requisite"), "CANDIDATE"), (F.col("acts") == 0, "MISSING_EVIDENCE"), otherwise="NEGATIVE_VERIFIED")
    return w.select("k", "works", "acts", status.alias("status"))


@query(
    "change_legitimacy",
    """
    with m as (select l_orderkey as k, l_linenumber as page, l_quantity as x, l_partkey from lineitem where l_returnflag = 'N'), c as (select distinct l_orderkey as k, l_linenumber as page, l_quantity as x from lineitem where l_returnflag = 'R'),
    j as (select c.k, c.page, c.x, count(m.k) as marks, count(m.k) filter (where m.l_partkey % 4 = 0) as approved, count(distinct m.l_partkey % 2) as opinions from c left join m on m.k = c.k and m.page = c.page and abs(m.x - c.x) <= 8 group by 1, 2, 3)
    select k, page, x, case when marks = 0 then 'NONE' when approved > 0 and opinions > 1 then 'CONFLICT' when approved > 0 then 'APPROVED' else 'UNVERIFIED' end as legitimacy from j
    """,
)
def change_legitimacy(spark, sf_dir):
    """Whether a change has a mark near it, and whether the register approves it."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), "l_partkey", "l_returnflag")
    changes = lines.where("l_returnflag = 'R'").select("k", "page", "x").distinct()
    marks = lines.where("l_returnflag = 'N'").select("k", "page", F.col("x").alias("mx"), "l_partkey")
    near = changes.join(marks, (changes.k == marks.k) & (changes.page == marks.page) & (F.abs(F.col("x") - F.col("mx")) <= 8), "left").select(changes.k, changes.page, "x", "l_partkey")
    j = near.groupBy("k", "page", "x").agg(F.count("l_partkey").alias("marks"), F.count_if(F.col("l_partkey") % 4 == 0).alias("approved"), F.countDistinct(F.col("l_partkey") % 2).alias("opinions"))
    kind = ladder((F.col("marks") == 0, "NONE"), ((F.col("approved") > 0) & (F.col("opinions") > 1), "CONFLICT"), (F.col("approved") > 0, "APPROVED"), otherwise="UNVERIFIED")
    return j.select("k", "page", "x", kind.alias("legitimacy"))


@query(
    "spec_vs_count",
    """
    with s as (select l_orderkey as k, p_type as item, sum(l_quantity) as specified from lineitem join part on l_partkey = p_partkey where l_returnflag = 'A' group by 1, 2),
    c as (select l_orderkey as k, p_type as item, count(*) * 20.0 as counted from lineitem join part on l_partkey = p_partkey where l_returnflag <> 'A' group by 1, 2)
    select coalesce(s.k, c.k) as k, coalesce(s.item, c.item) as item, specified, counted, case when specified is null then 'NOT_IN_SPEC' when counted is null then 'NOT_DRAWN' else 'DIFFERS' end as kind
    from s full outer join c on s.k = c.k and s.item = c.item where specified is null or counted is null or abs(specified - counted) > 30
    """,
    {"counted": "double"},
)
def spec_vs_count(spark, sf_dir):
    """What a specification lists against what drawings show, across documents."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    keys = [F.col("l_orderkey").alias("k"), F.col("p_type").alias("item")]
    s = rows.where("l_returnflag = 'A'").groupBy(*keys).agg(F.sum("l_quantity").alias("specified"))
    c = rows.where("l_returnflag <> 'A'").groupBy(*keys).agg((F.count("*") * 20.0).alias("counted"))
    both = s.join(c, ["k", "item"], "full_outer").where("specified is null or counted is null or abs(specified - counted) > 30")
    return both.withColumn("kind", F.when(F.col("specified").isNull(), "NOT_IN_SPEC").when(F.col("counted").isNull(), "NOT_DRAWN").otherwise("DIFFERS"))


@query(
    "rooms_missing",
    """
    select o.l_orderkey as k, o.l_linenumber as room, count(*) as mentions from lineitem o where o.l_returnflag = 'R'
      and not exists (select 1 from lineitem a where a.l_returnflag in ('A', 'N') and a.l_orderkey = o.l_orderkey and a.l_linenumber = o.l_linenumber)
      and exists (select 1 from lineitem a where a.l_returnflag in ('A', 'N') and a.l_orderkey = o.l_orderkey) group by 1, 2
    """,
)
def rooms_missing(spark, sf_dir):
    """Rooms one discipline serves that the other doesn't have, where it has any."""
    lines = table(spark, sf_dir, "lineitem")
    plan = lines.where("l_returnflag in ('A', 'N')").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("room")).distinct()
    served = lines.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("room")).agg(F.count("*").alias("mentions"))
    return served.join(plan, ["k", "room"], "left_anti").join(plan.select("k").distinct(), "k", "left_semi")


@query(
    "stage_cells",
    """
    select l_partkey, case when count(*) filter (where l_returnflag = 'A') = 0 then 'NO_VALUE' when bool_or(l_returnflag = 'A' and l_linestatus = 'O') then 'USED' else 'NOT_APPLICABLE' end as pd,
      case when count(*) filter (where l_returnflag = 'N') = 0 then 'NO_VALUE' when bool_or(l_returnflag = 'N' and l_linestatus = 'O') then 'USED' else 'NOT_APPLICABLE' end as rd,
      max(l_shipdate)::date as latest from lineitem where l_discount > 0.07 group by 1
    """,
)
def stage_cells(spark, sf_dir):
    """Notes of the stages of a key parameter."""

    def cell(flag, name):
        here = F.col("l_returnflag") == flag
        return F.when(F.count_if(here) == 0, "NO_VALUE").when(F.bool_or(here & (F.col("l_linestatus") == "O")), "USED").otherwise("NOT_APPLICABLE").alias(name)

    rows = table(spark, sf_dir, "lineitem").where("l_discount > 0.07")
    return rows.groupBy("l_partkey").agg(cell("A", "pd"), cell("N", "rd"), F.max("l_shipdate").cast("date").alias("latest"))


@query(
    "integrity_report",
    """
    with d as (select o_orderkey as k from orders where o_orderkey % 2 = 0), s as (select distinct l_orderkey as k from lineitem where l_quantity > 10), r as (select distinct l_orderkey as k from lineitem where l_quantity <= 2)
    select case when d.k is null then 'UNDECLARED' when s.k is not null then 'STORED' when r.k is not null then 'REJECTED' else 'LOST' end as state, count(*) as n
    from d full outer join s on d.k = s.k left join r on r.k = coalesce(d.k, s.k) group by 1
    """,
)
def integrity_report(spark, sf_dir):
    """Files declared, stored and rejected."""
    lines = table(spark, sf_dir, "lineitem")
    d = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(True).alias("d"))
    s = lines.where("l_quantity > 10").select(F.col("l_orderkey").alias("k"), F.lit(True).alias("s")).distinct()
    r = lines.where("l_quantity <= 2").select(F.col("l_orderkey").alias("k"), F.lit(True).alias("r")).distinct()
    state = F.when(F.col("d").isNull(), "UNDECLARED").when(F.col("s"), "STORED").when(F.col("r"), "REJECTED").otherwise("LOST")
    return d.join(s, "k", "full_outer").join(r, "k", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query(
    "revision_pairs",
    """
    select prev, next, gap from (select o_orderkey as next, lag(o_orderkey) over w as prev, datediff('day', lag(o_orderdate) over w, o_orderdate) as gap from orders window w as (partition by o_custkey, o_orderstatus order by o_orderdate, o_orderkey)) t
    where prev is not null and gap <= 30
    """,
    {"gap": "integer"},
)
def revision_pairs(spark, sf_dir):
    """Each revision with the one before, to compare sheet by sheet."""
    by = W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderdate", "o_orderkey")
    before, gap = F.lag("o_orderkey").over(by), F.datediff("o_orderdate", F.lag("o_orderdate").over(by))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("next"), before.alias("prev"), gap.alias("gap"))
    return rows.where("prev is not null and gap <= 30").select("prev", "next", "gap")


@query(
    "best_table_cell",
    """
    select k, param, value from (select l_orderkey as k, p_type as param, l_extendedprice as value, row_number() over (partition by l_orderkey, p_type order by l_quantity desc, l_linenumber, l_partkey, l_suppkey) as rn
      from lineitem join part on l_partkey = p_partkey) t where rn = 1
    """,
)
def best_table_cell(spark, sf_dir):
    """The best candidate cell of each parameter."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    best = first_per(rows, ["l_orderkey", "p_type"], [F.desc("l_quantity"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")])
    return best.select(F.col("l_orderkey").alias("k"), F.col("p_type").alias("param"), F.col("l_extendedprice").alias("value"))
