"""The kinds over the test tables: four orders are an object, line items its mentions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom import kinds
from factloom.functions.classes import DIMENSIONS
from factloom.kinds.lowering import Gates, lower
from factloom.plans.registry import query
from factloom.sources.tables import dealt, table

MENTIONS = """
(select l_orderkey // 4 as object_id, 'P' || (l_partkey % 6) as param_code, case l_returnflag when 'A' then 'PD' when 'N' then 'RD' else 'ID' end as stage,
    case when l_linenumber <> 7 then l_quantity end as value_num, case when l_linenumber = 7 then 'C' || (l_suppkey % 4) end as value_text,
    'C' || (l_suppkey % 4) as class, case when l_discount > 0.095 then 'CONFLICT' else 'CURRENT' end as role, 1 - l_tax as confidence, cast(l_suppkey as varchar) as file_id, l_linenumber as page,
    case when l_linestatus = 'O' then 'x' end as element, case when l_quantity > 12 then 'PRESENT' else 'ABSENT' end as state, 'a' || (l_suppkey % 2) as aspect, l_linenumber = 6 as hint
 from lineitem)
"""
PICK = "qualify row_number() over (partition by object_id, param_code, stage order by confidence desc, file_id, page, value_num nulls first, value_text nulls first) = 1"


def _mentions(spark, sf_dir):
    line = F.col("l_linenumber")
    stage = F.when(F.col("l_returnflag") == "A", "PD").when(F.col("l_returnflag") == "N", "RD").otherwise("ID")
    name = F.concat(F.lit("C"), (F.col("l_suppkey") % 4).cast("string"))
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("object_id"), F.concat(F.lit("P"), (F.col("l_partkey") % 6).cast("string")).alias("param_code"), stage.alias("stage"),
        F.when(line != 7, F.col("l_quantity")).alias("value_num"), F.when(line == 7, name).alias("value_text"), name.alias("class"),
        F.when(F.col("l_discount") > 0.095, "CONFLICT").otherwise("CURRENT").alias("role"), (1 - F.col("l_tax")).alias("confidence"), F.col("l_suppkey").cast("string").alias("file_id"), line.alias("page"),
        F.when(F.col("l_linestatus") == "O", "x").alias("element"), F.when(F.col("l_quantity") > 12, "PRESENT").otherwise("ABSENT").alias("state"),
        F.concat(F.lit("a"), (F.col("l_suppkey") % 2).cast("string")).alias("aspect"), (line == 6).alias("hint"), F.lit(None).cast("string").alias("variant"),
    )


def _params(spark, kind, **settings):
    """Six params of one kind; a list gives each its own setting."""
    rows = [(f"P{i}", kind, *[v[i] if isinstance(v, list) else v[0] for v in settings.values()]) for i in range(6)]
    types = {"rule": "string", "tolerance": "double", "low": "double", "high": "double", "scale": "array<string>", "direction": "string", "tolerance_abs": "double", "tolerance_pct": "double",
             "factors": "array<double>", "cert_match": "boolean", "separate": "array<string>", "pd_silent": "string", "applicability": "string"}
    return spark.createDataFrame(rows, ", ".join(["param_code string", "kind string", *(f"{k} {types[k]}" for k in settings)]))


def _profiles(spark, sf_dir):
    """Objects of a cancelled first order have no gas."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.floor(F.col("o_orderkey") / 4).alias("object_id"), F.lit("gas").alias("flag"), F.lit(False).alias("value"))


NO_GAS = "(select distinct o_orderkey // 4 as object_id, true as denied from orders where o_orderstatus = 'P')"


@query(
    "kind_generic",
    f"""
    with p as (select * from {MENTIONS} m {PICK}),
    w as (select object_id, param_code, bool_or(role = 'CONFLICT') as disputed, count(*) as n, bool_or(value_num is null) as no_number,
        min_by(struct_pack(num := value_num, txt := value_text, st := stage), case stage when 'PD' then 1 when 'RD' then 2 else 3 end) as e,
        list(struct_pack(num := value_num, txt := value_text, st := stage) order by case stage when 'PD' then 1 when 'RD' then 2 else 3 end) as vs from p group by 1, 2),
    f as (select w.*, param_code in ('P4', 'P5') as threshold, param_code = 'P0' and denied is not null as na,
        list_transform(vs[2:], lambda v: struct_pack(st := v.st, bad := case param_code
            when 'P0' then case when v.num is not null and e.num is not null then v.num <> e.num else v.txt <> e.txt end
            when 'P1' then case when v.num is not null and e.num is not null and e.num <> 0 then abs((v.num - e.num) / e.num) * 100 > 50 end
            when 'P2' then case when v.num is not null and e.num is not null then v.num < e.num else v.txt < e.txt end
            else case when v.num is not null and e.num is not null then v.num > e.num else v.txt > e.txt end end)) as later,
        list_filter(vs, lambda v: case param_code when 'P4' then v.num < 10 else v.num > 40 end) as beyond
      from w left join {NO_GAS} g using (object_id)),
    s as (select *, case when na then 'NOT_APPLICABLE' when disputed then 'CLARIFICATION_REQUIRED' when threshold and no_number then 'NOT_COMPARABLE' when threshold and len(beyond) > 0 then 'CANDIDATE'
        when threshold then 'NEGATIVE_VERIFIED' when n < 2 then 'MISSING_EVIDENCE' when len(list_filter(later, lambda v: v.bad is null)) > 0 then 'NOT_COMPARABLE'
        when len(list_filter(later, lambda v: v.bad)) > 0 then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as status from f)
    select object_id, param_code, status, case when status = 'CANDIDATE' and not threshold then e.st end as expected_stage,
        case when status = 'CANDIDATE' then case when threshold then beyond[-1].st else list_filter(later, lambda v: v.bad)[-1].st end end as worst_stage from s
    """,
)
def kind_generic(spark, sf_dir):
    params = _params(spark, "generic", rule=["equal", "delta_pct", "decrease", "increase", "min", "max"], tolerance=[50.0] * 6, low=[10.0] * 6, high=[40.0] * 6,
                     scale=[["C0", "C1", "C2", "C3"]] * 6, applicability=["gas", None, None, None, None, None])
    return kinds.evaluate("generic", _mentions(spark, sf_dir), params, profiles=_profiles(spark, sf_dir))


@query(
    "kind_count",
    f"""
    with m as (select * from {MENTIONS} m where value_num is not null), p as (select * from m {PICK}),
    d as (select object_id, param_code, bool_or(n > 1) as disagree from (select object_id, param_code, stage, count(distinct value_num) as n from m group by 1, 2, 3) t group by 1, 2),
    w as (select object_id, param_code, bool_or(role = 'CONFLICT') as disputed, count(*) as n, count(distinct value_num) as different,
        max(case when stage = 'PD' then value_num end) as pd, max(case when stage = 'RD' then value_num end) as rd, max(case when stage = 'ID' then value_num end) as id from p group by 1, 2),
    k as (select distinct object_id, param_code from {MENTIONS} m)
    select object_id, param_code, case when disputed then 'CLARIFICATION_REQUIRED' when coalesce(n, 0) < 2 then 'MISSING_EVIDENCE' when different = 1 then 'NEGATIVE_VERIFIED'
        when disagree then 'CLARIFICATION_REQUIRED' else 'CANDIDATE' end as status, pd, rd, id from k left join w using (object_id, param_code) left join d using (object_id, param_code)
    """,
)
def kind_count(spark, sf_dir):
    return kinds.evaluate("count", _mentions(spark, sf_dir), _params(spark, "count", tolerance=[0.0] * 6))


QUANTITY_STATUS = """case when disputed then 'CLARIFICATION_REQUIRED' when norm_value is not null then 'CANDIDATE' when coalesce(n, 0) < 2 and unitless then 'NOT_COMPARABLE' when coalesce(n, 0) < 2 then 'MISSING_EVIDENCE'
    when scaled then 'NOT_COMPARABLE' when far is not null then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end"""


@query(
    "kind_quantity",
    f"""
    with m as (select * exclude (element) from {MENTIONS} m), p as (select * from m where value_num is not null qualify row_number() over (partition by object_id, param_code, stage order by confidence desc, file_id, page, value_num) = 1),
    w as (select object_id, param_code, bool_or(role = 'CONFLICT') as disputed, count(*) as n, min_by(value_num, case stage when 'PD' then 1 when 'RD' then 2 else 3 end) as e, min(case stage when 'PD' then 1 when 'RD' then 2 else 3 end) as es from p group by 1, 2),
    j as (select p.object_id, p.param_code, p.value_num as v, e, case stage when 'RD' then 2 else 3 end as st from p join w using (object_id, param_code) where case stage when 'PD' then 1 when 'RD' then 2 else 3 end > es),
    f as (select object_id, param_code, bool_or(greatest(v, e) / least(v, e) between 5 and 15) as scaled, arg_max(v, abs(v - e) * 10 - st) filter (where e - v > greatest(3.0, e * 10 / 100) + 1e-9) as far from j group by 1, 2),
    b as (select object_id, param_code, arg_max(value_num, value_num) as norm_value from m where param_code = 'P1' and value_num > 49 + 1e-9 group by 1, 2),
    k as (select object_id, param_code, bool_or(value_num is null) as unitless from m group by 1, 2)
    select object_id, param_code, {QUANTITY_STATUS} as status, coalesce(norm_value, case when {QUANTITY_STATUS} = 'CANDIDATE' then far end) as actual, cast(1 as bigint) as parts
    from k left join w using (object_id, param_code) left join f using (object_id, param_code) left join b using (object_id, param_code)
    """,
)
def kind_quantity(spark, sf_dir):
    params = _params(spark, "quantity", direction=["decrease"] * 6, tolerance_abs=[3.0] * 6, tolerance_pct=[10.0] * 6, factors=[[10.0]] * 6)
    norms = spark.createDataFrame([("P1", "max", 49.0, "fail"), ("P2", "max", 20.0, "warn")], "param_code string, side string, bound double, severity string")
    return kinds.evaluate("quantity", _mentions(spark, sf_dir).withColumn("element", F.lit(None).cast("string")), params, norms=norms)


@query(
    "kind_class",
    f"""
    with m as (select object_id, param_code, coalesce(element, '') as element, stage, role, confidence, file_id, page, class as value_text, case class when 'C0' then 1 when 'C1' then 2 when 'C2' then 3 end as rank,
        case stage when 'PD' then 1 when 'RD' then 2 else 3 end as st from {MENTIONS} m),
    c as (select * from m qualify row_number() over (partition by object_id, param_code, element, st order by confidence desc, file_id, page, value_text) = 1),
    j as (select a.object_id, a.param_code, a.element, a.st, a.rank as now, b.rank as was from c a join c b on a.object_id = b.object_id and a.param_code = b.param_code and b.st < a.st and (b.element = a.element or b.element = '')
        qualify row_number() over (partition by a.object_id, a.param_code, a.element, a.st order by b.element = a.element desc, (a.param_code in ('P0', 'P1') and a.st = 3 and b.st = 2) desc, b.st) = 1),
    f as (select object_id, param_code, count(*) as pairs, max(was - now) as dropped, bool_or(was is null or now is null) as odd from j group by 1, 2),
    s as (select object_id, param_code, count(distinct case when rank is not null then st end) as ranked, bool_or(rank is null) as other, bool_or(role = 'CONFLICT') as disputed from c group by 1, 2)
    select object_id, param_code, case when disputed then 'CLARIFICATION_REQUIRED' when ranked < 2 and other then 'NOT_COMPARABLE' when ranked < 2 then 'MISSING_EVIDENCE' when pairs is null then 'NOT_COMPARABLE'
        when coalesce(dropped > 0, false) then 'CANDIDATE' when odd then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status, coalesce(pairs, 0) as pairs, cast(case when dropped > 0 then dropped end as double) as drop
    from s left join f using (object_id, param_code)
    """,
)
def kind_class(spark, sf_dir):
    params = _params(spark, "class", scale=[["C0", "C1", "C2"]] * 6, cert_match=[True, True, False, False, False, False])
    return kinds.evaluate("class", _mentions(spark, sf_dir).withColumn("value_text", F.col("class")), params)


DIMS = [("strength", "number", None, None), ("limit", "flags", ["E", "I", "W"], {"W": ["E"]}), ("group", "ladder", ["LS", "FRLS"], None)]


@query(
    "kind_class_vectors",
    f"""
    with m as (select object_id, param_code, coalesce(element, '') as element, stage, role, confidence, file_id, page, class, case stage when 'PD' then 1 when 'RD' then 2 else 3 end as st,
        cast(cast(price as integer) % 3 as integer) + 1 as strength, cast(price as integer) % 5 as fl, cast(price as integer) % 7 as gr
        from (select *, coalesce(value_num, 0) as price from {MENTIONS} x) y),
    v as (select *, case when fl = 0 then ['E'] when fl = 1 then ['E', 'I'] when fl = 2 then ['E', 'W'] else ['E', 'I', 'W'] end as flags, case when gr < 3 then 0 when gr < 6 then 1 end as step,
        case when fl = 0 then 'E' when fl = 1 then 'EI' when fl = 2 then 'W' else 'IW' end || ' ' || strength || case when gr < 3 then ' - LS' when gr < 6 then ' FRLS' else '' end as value_text from m),
    c as (select * from v qualify row_number() over (partition by object_id, param_code, element, st order by confidence desc, file_id, page, value_text) = 1),
    j as (select a.object_id, a.param_code, a.element, a.st, a.step is null or b.step is null as odd,
        (a.strength < b.strength)::int + (len(list_filter(b.flags, lambda x: not list_contains(a.flags, x))) > 0)::int + (a.step < b.step)::int as worse
        from c a join c b on a.object_id = b.object_id and a.param_code = b.param_code and b.st < a.st and (b.element = a.element or b.element = '')
        qualify row_number() over (partition by a.object_id, a.param_code, a.element, a.st order by b.element = a.element desc, (a.param_code in ('P0', 'P1') and a.st = 3 and b.st = 2) desc, b.st) = 1),
    f as (select object_id, param_code, count(*) as pairs, max(case when not odd then worse end) as dropped, bool_or(odd) as odd from j group by 1, 2),
    s as (select object_id, param_code, count(distinct case when step is not null then st end) as ranked, bool_or(step is null) as other, bool_or(role = 'CONFLICT') as disputed from c group by 1, 2)
    select object_id, param_code, case when disputed then 'CLARIFICATION_REQUIRED' when ranked < 2 and other then 'NOT_COMPARABLE' when ranked < 2 then 'MISSING_EVIDENCE' when pairs is null then 'NOT_COMPARABLE'
        when coalesce(dropped > 0, false) then 'CANDIDATE' when odd then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status, coalesce(pairs, 0) as pairs, cast(case when dropped > 0 then dropped end as double) as drop
    from s left join f using (object_id, param_code)
    """,
)
def kind_class_vectors(spark, sf_dir):
    """Classes of several dimensions, which are only partly in order."""
    mentions = _mentions(spark, sf_dir)
    number = F.coalesce("value_num", F.lit(0.0)).cast("int")
    flags = F.when(number % 5 == 0, "E").when(number % 5 == 1, "EI").when(number % 5 == 2, "W").otherwise("IW")
    group = F.when(number % 7 < 3, " - LS").when(number % 7 < 6, " FRLS").otherwise("")
    text = F.concat(flags, F.lit(" "), (number % 3 + 1).cast("string"), group)
    params = _params(spark, "class", scale=[None] * 6, cert_match=[True, True, False, False, False, False])
    dims = spark.createDataFrame([(DIMS,)], f"dims {DIMENSIONS}")
    return kinds.evaluate("class", mentions.withColumn("value_text", text), params.crossJoin(F.broadcast(dims)))


@query(
    "kind_composition",
    f"""
    with a as (select object_id, param_code, case stage when 'PD' then 1 when 'RD' then 2 else 3 end as st, class, sum(value_num) as amount from {MENTIONS} m group by 1, 2, 3, 4),
    t as (select object_id, param_code, st, sum(amount) as total, min(st) over (partition by object_id, param_code) as fst, count(*) over (partition by object_id, param_code) as n from a group by 1, 2, 3),
    s as (select a.object_id, a.param_code, a.st, a.class, amount * 100 / total as share, fst from a join t using (object_id, param_code, st)),
    l as (select object_id, param_code, st from t where st > fst),
    o as (select l.object_id, l.param_code, l.st, s.class, s.share as was from s join l on s.object_id = l.object_id and s.param_code = l.param_code and s.st = s.fst),
    b as (select object_id, param_code, st, class, was, share as now from o full join (select * from s where st > fst) x using (object_id, param_code, st, class)),
    c as (select b.object_id, b.param_code, bool_or((o.k is null or n.k is null) and class = 'C3') as apart,
        min(case when (o.k is null or n.k is null) and class <> 'C3' or coalesce(abs(now - was) > 20, false) then st end) as changed
        from (select *, was is not null as has_was, now is not null as has_now from b) b, lateral (select case when has_was then 1 end as k) o, lateral (select case when has_now then 1 end as k) n group by 1, 2),
    k as (select distinct object_id, param_code, n from t)
    select object_id, param_code, case when n < 2 then 'MISSING_EVIDENCE' when apart then 'NOT_COMPARABLE' when changed is not null then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as status,
        case when n >= 2 and not apart and changed is not null then ['PD', 'RD', 'ID'][changed] end as changed_stage from k left join c using (object_id, param_code)
    """,
)
def kind_composition(spark, sf_dir):
    params = _params(spark, "composition", tolerance=[20.0] * 6, separate=[["C3"]] * 6)
    return kinds.evaluate("composition", _mentions(spark, sf_dir).withColumn("value_text", F.col("class")), params)


@query(
    "kind_category",
    f"""
    with n as (select * replace (case class when 'C1' then 'C0' else class end as class), class as value_text from (select * exclude (value_text) from {MENTIONS} m) x),
    p as (select * from n {PICK}),
    w as (select object_id, param_code, bool_or(role = 'CONFLICT') as disputed, count(*) as stages, max(case when stage = 'PD' then class end) as pd,
        list(class) filter (where stage <> 'PD') as later from p group by 1, 2),
    f as (select *, list_transform(coalesce(later, []), lambda x: case when x = pd then 'S' when pd = 'C0' and x = 'C2' then 'E' when pd = 'C0' and x = 'C3' or pd = 'C2' and x = 'C3' then 'N' else 'U' end) as d from w)
    select object_id, param_code, case when disputed then 'CLARIFICATION_REQUIRED' when pd is null or len(d) = 0 then 'MISSING_EVIDENCE' when list_contains(d, 'N') then 'CANDIDATE'
        when list_contains(d, 'U') then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status, cast(stages as integer) as stages from f
    """,
)
def kind_category(spark, sf_dir):
    aliases = spark.createDataFrame([("C1", "C0")], "name string, canonical string")
    analogs = spark.createDataFrame([("C0", "C2", "EQUIVALENT"), ("C0", "C3", "NOT_EQUIVALENT"), ("C2", "C3", "NOT_EQUIVALENT")], "canonical string, substitute string, verdict string")
    return kinds.evaluate("category", _mentions(spark, sf_dir).withColumn("value_text", F.col("class")), _params(spark, "category", tolerance=[0.0] * 6), aliases=aliases, analogs=analogs)


@query(
    "kind_presence",
    f"""
    with b as (select object_id, param_code, aspect, stage, bool_or(state = 'PRESENT' and not hint) as p, bool_or(state = 'ABSENT' and not hint) as a, bool_or(hint) as h, max(value_num) as q from {MENTIONS} m group by 1, 2, 3, 4),
    s as (select *, case when p and a then 'MIXED' when p then 'PRESENT' when a then 'ABSENT' when h then 'HINT' end as st from b),
    w as (select object_id, param_code, aspect, coalesce(max(case when stage = 'PD' then st end), 'SILENT') as pd, max(case when stage = 'RD' then st end) as rd, max(case when stage = 'ID' then st end) as id,
        max(case when stage = 'PD' then q end) as qp, max(case when stage = 'RD' then q end) as qr, max(case when stage = 'ID' then q end) as qi from s group by 1, 2, 3),
    j as (select *, [coalesce(rd, ''), coalesce(id, '')] as l from w),
    v as (select *, case when pd in ('SILENT', 'ABSENT', 'HINT') then 5 when pd = 'MIXED' then 2 when list_contains(l, 'ABSENT') then 1 when list_contains(l, 'MIXED') then 2
        when list_contains(l, 'HINT') and not list_contains(l, 'PRESENT') then 2 when rd is null or id is null then 3 when coalesce(qr < qp, false) or coalesce(qi < qp, false) then 1 else 4 end as sev from j),
    r as (select object_id, param_code, min(sev) as sev, arg_min(aspect, sev * 10 + cast(aspect[2:] as integer)) as aspect from v group by 1, 2),
    f as (select object_id, param_code, bool_or(role = 'CONFLICT') as disputed, bool_or(stage = 'PD') as has_pd, bool_or(stage = 'PD' and state = 'ABSENT') as excluded from {MENTIONS} m group by 1, 2)
    select object_id, param_code, case when disputed then 'CLARIFICATION_REQUIRED' when not has_pd then 'MISSING_EVIDENCE' when sev = 5 and excluded then 'NOT_APPLICABLE' when sev = 5 and param_code = 'P0' then 'NOT_APPLICABLE' when sev = 5 then 'MISSING_EVIDENCE'
        else ['CANDIDATE', 'NOT_COMPARABLE', 'MISSING_EVIDENCE', 'NEGATIVE_VERIFIED'][sev] end as status, case when has_pd then aspect end as aspect from f left join r using (object_id, param_code)
    """,
)
def kind_presence(spark, sf_dir):
    return kinds.evaluate("presence", _mentions(spark, sf_dir), _params(spark, "presence", pd_silent=["NOT_APPLICABLE", *["MISSING_EVIDENCE"] * 5]))


@query(
    "kind_method",
    f"""
    with m as (select object_id, param_code, stage, role, class from {MENTIONS} m), g(term, ancestor) as (values ('C0', 'C0'), ('C1', 'C1'), ('C1', 'C0'), ('C2', 'C2')),
    k as (select object_id, param_code, bool_or(role = 'CONFLICT') as disputed, bool_or(stage = 'PD') as pd, bool_or(stage = 'PD' and class <> 'C3') as known, bool_or(stage <> 'PD' and class = 'C3') as odd from m group by 1, 2),
    l as (select distinct object_id, param_code, class from m where stage <> 'PD' and class <> 'C3'),
    r as (select l.object_id, l.param_code, l.class, bool_or(m.class is not null) as fits from l left join g on g.term = l.class left join m on m.object_id = l.object_id and m.param_code = l.param_code and m.stage = 'PD' and m.class = g.ancestor group by 1, 2, 3),
    f as (select object_id, param_code, bool_or(not fits) as unrelated, bool_or(fits) as related from r group by 1, 2)
    select object_id, param_code, case when disputed then 'CLARIFICATION_REQUIRED' when not pd then 'NOT_APPLICABLE' when not known then 'NOT_COMPARABLE' when unrelated then 'CANDIDATE' when related then 'NEGATIVE_VERIFIED'
        when odd then 'NOT_COMPARABLE' else 'MISSING_EVIDENCE' end as status from k left join f using (object_id, param_code)
    """,
)
def kind_method(spark, sf_dir):
    lineage = spark.createDataFrame([("C0", "C0"), ("C1", "C1"), ("C1", "C0"), ("C2", "C2")], "term string, ancestor string")
    return kinds.evaluate("method", _mentions(spark, sf_dir).withColumn("value_text", F.col("class")), _params(spark, "method", tolerance=[0.0] * 6), lineage=lineage)


LOWERED = """
    l as (select l_orderkey // 4 as object_id, l_partkey % 8 as p, l_suppkey as s, l_linenumber as n, l_quantity as q, l_discount as d, l_tax as t, l_returnflag as f, l_partkey // 8 as k from lineitem),
    fi as (select object_id, p, object_id * 8 + p as finding_id, case when count(*) % 5 < 4 then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as status, 'B' || (min(s) % 3 + 1) as expected,
        case when p = 7 then 'B' || (min(s) % 3 + 1) || ' W6' else 'B' || (max(s) % 3 + 4) end as actual, p = 5 as threshold, p = 4 as absence from l group by 1, 2),
    fr as (select fi.*, l.s, n, case f when 'A' then 'expected' else 'actual' end as side, case when f = 'A' then expected when l.p = 7 then expected || ' W6' when l.p = 4 and n % 2 = 0 then '—' else 'B' || (l.s % 3 + 4) end as value,
        case f when 'A' then 'PD' when 'N' then 'RD' else 'ID' end as stage, 'C' || (l.s % 2) as code, case when t > 0.077 then '2' else '1' end as revision, d > 0.098 as disputed, d < 0.002 as stale,
        'F' || (l.s % 5) as file_id, n = 3 as unplaced, l.p % 2 = 1 and k % 6 = 0 as wrong, q < 3 or 1 - t < case when l.p = 0 then 0.93 else 0.921 end as poor, 'm' || (k % 9) as method from l join fi using (object_id, p)),
    h as (select finding_id, bool_or(side = 'actual' and value = actual) as hit from fr group by 1),
    o as (select fr.*, case when status = 'CANDIDATE' and hit then side = 'actual' and value = actual else side = 'actual' end as acts from fr join h using (finding_id)),
    w as (select *, acts or side = 'expected' and not threshold as weighs from o),
    fl as (select finding_id, bool_or(weighs and poor) as any_poor, coalesce(bool_and(poor) filter (where weighs and side = 'expected'), false) or coalesce(bool_and(poor) filter (where weighs and side = 'actual'), false) as all_poor,
        bool_or(disputed) as disputed, bool_or(stale) as stale, count(*) filter (where side = 'actual') as n_actual, count(*) filter (where side = 'expected') as n_expected,
        bool_or(side = 'actual' and value = '—' and unplaced) as nowhere, bool_or(side = 'actual' and value = '—') as empty, count(distinct stage) filter (where side = 'actual' and (threshold or value <> expected)) as atoms from w group by 1),
    mx as (select finding_id, bool_or(r > 1) as mixed from (select finding_id, stage, code, count(distinct revision) as r from w group by 1, 2, 3) z group by 1),
    cm as (select a.finding_id, bool_or(a.wrong or coalesce(e.wrong, false) or coalesce(a.method <> e.method and not (a.method <> 'm8' and e.method <> 'm8'), false)) as any_bad,
        bool_and(a.wrong or coalesce(e.wrong, false) or coalesce(a.method <> e.method and not (a.method <> 'm8' and e.method <> 'm8'), false)) as all_bad
        from w a left join w e on e.finding_id = a.finding_id and e.side = 'expected' and not e.threshold where a.acts group by 1),
    os as (select finding_id, case when n = 2 then 3 end as number, n = 4 as stamped from w where acts and file_id = 'F1' and (n = 2 and not unplaced or n = 4)),
    rg as (select fi.finding_id, 3 as number, not coalesce(list_contains(a.files, 'F2'), false) as founded from fi left join (select finding_id, list(file_id) as files from w where acts group by 1) a using (finding_id) where p = 6 or p = 2
        union all select finding_id, 8, true from fi where p = 3),
    lg as (select finding_id, count(r.finding_id) as reg, count(m.number) as numbered, bool_or(r.founded) filter (where m.number = r.number) as same from (select distinct finding_id from os union select finding_id from rg) u
        left join (select finding_id, number from os) m using (finding_id) left join rg r using (finding_id) group by 1),
    cv as (select distinct w.finding_id, object_id % 2 = 0 as holes from w where side = 'actual' and stage = 'RD' and object_id % 3 > 0),
    z as (select fi.*, any_poor, all_poor, disputed or mixed as unsettled, stale, coalesce(n_actual, 0) = 0 or not threshold and n_expected = 0 or nowhere as lacks, absence or empty as absent, atoms, coalesce(any_bad, false) as any_bad, coalesce(all_bad, false) as all_bad,
        cv.finding_id is not null as sheet, coalesce(holes, false) as holes, case when lg.finding_id is not null then case when reg > 0 and numbered > 0 and same is null then 'CHANGE_CONFLICT' when same then 'APPROVED_CHANGE' else 'CHANGE_APPROVAL_UNVERIFIED' end else 'NONE' end as legit
        from fi join fl using (finding_id) join mx using (finding_id) left join cm using (finding_id) left join cv using (finding_id) left join lg using (finding_id)),
    st as (select *, case when status = 'CANDIDATE' and any_bad or status <> 'CANDIDATE' and all_bad then 'GTE-04' when status = 'CANDIDATE' and any_poor or status <> 'CANDIDATE' and all_poor then 'GTE-05' when unsettled then 'VER-01' when stale then 'VER-03'
        when status <> 'CANDIDATE' then '' when lacks then 'VER-02' when absent and (not sheet or holes) then 'VER-05' when not threshold and p = 7 then 'VER-07' when legit in ('APPROVED_CHANGE', 'CHANGE_CONFLICT') then 'VER-08' else '' end as step from z)
"""


@query(
    "kind_lowering",
    f"""
    with {LOWERED}
    select finding_id, case when step in ('GTE-04', 'GTE-05', 'VER-02') or step = 'VER-05' and sheet then 'NOT_COMPARABLE' when step = 'VER-05' then 'MISSING_EVIDENCE' when step in ('VER-01', 'VER-03') or step = 'VER-08' and legit = 'CHANGE_CONFLICT' then 'CLARIFICATION_REQUIRED'
        when step in ('VER-07', 'VER-08') then 'NEGATIVE_VERIFIED' else status end as status, step as steps, case when status = 'CANDIDATE' and step in ('', 'VER-08') then legit end as change,
        array_to_string(list_filter([case when step = 'VER-03' then 'STALE_REVISION' end, case when status = 'CANDIDATE' and step = '' and legit = 'CHANGE_APPROVAL_UNVERIFIED' then legit end, case when status = 'CANDIDATE' and step = '' and atoms > 1 then 'COMPOSITE' end], lambda x: x is not null), ' ') as flags from st
    """,
)
def kind_lowering(spark, sf_dir):
    """Findings after every check that may lower them, with the check that did."""
    every = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4).alias("object_id"), (F.col("l_partkey") % 8).alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"),
        F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), F.col("l_returnflag").alias("f"), F.floor(F.col("l_partkey") / 8).alias("k"),
    )
    lines = dealt(every.withColumn("finding_id", F.col("object_id") * 8 + F.col("p")), "finding_id", rows=200_000)
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    expected = lambda least: text("B", least % 3 + 1)
    findings = lines.groupBy("finding_id", "object_id", "p").agg(
        F.when(F.count("*") % 5 < 4, "CANDIDATE").otherwise("NEGATIVE_VERIFIED").alias("status"), expected(F.min("s")).alias("expected"),
        F.when(F.col("p") == 7, F.concat(expected(F.min("s")), F.lit(" W6"))).otherwise(text("B", F.max("s") % 3 + 4)).alias("actual"),
    )
    p, side = F.col("p"), F.when(F.col("f") == "A", "expected").otherwise("actual")
    findings = findings.withColumns({"param_code": text("P", p), "op": F.when(p % 2 == 0, "CMP-01").otherwise("CMP-04"), "threshold": p == 5, "absence": p == 4})
    actual = F.when(p == 7, F.concat("expected", F.lit(" W6"))).when((p == 4) & (F.col("n") % 2 == 0), "—").otherwise(text("B", F.col("s") % 3 + 4))
    fragments = lines.withColumn("expected", expected(F.min("s").over(W.partitionBy("finding_id")))).select(
        "finding_id", side.alias("side"), F.when(F.col("f") == "A", F.col("expected")).otherwise(actual).alias("value"), F.when(F.col("f") == "A", "PD").when(F.col("f") == "N", "RD").otherwise("ID").alias("stage"),
        text("C", F.col("s") % 2).alias("document_code"), F.when(F.col("t") > 0.077, "2").otherwise("1").alias("revision"), F.when(F.col("d") > 0.098, "CONFLICT").when(F.col("d") < 0.002, "SUPERSEDED").otherwise("CURRENT").alias("role"),
        F.lit("APPROVED").alias("approval_status"), text("F", F.col("s") % 5).alias("file_id"), F.col("n").alias("page"), F.when(F.col("n") != 3, F.array(*map(F.lit, (0.1, 0.1, 0.2, 0.2)))).alias("bbox"),
        F.when(F.col("k") % 6 == 0, "table").otherwise("plan").alias("doc_kind"), F.when(F.col("q") < 3, "LOW_QUALITY").otherwise("OK").alias("quality"), (1 - F.col("t")).alias("confidence"), F.lit("m").alias("unit"), text("m", F.col("k") % 9).alias("method"),
    )
    changed = every.where("p in (2, 3, 6)").select("object_id", "p").distinct()
    changes = changed.select("object_id", text("P", p).alias("param_code"), F.when(p == 3, "8").otherwise("No. 3").alias("number"), F.when(p == 3, "F9").otherwise("F2").alias("basis_file_id"))
    marks = spark.createDataFrame([("F1", 2, "cloud", "3", [0.22, 0.1, 0.3, 0.2]), ("F1", 4, "stamp_row", "3", None)], "file_id string, page int, kind string, number string, bbox array<double>")
    objects = every.select("object_id").distinct().where("object_id % 3 > 0")
    searched = objects.select("object_id", F.lit("RD").alias("stage"), F.lit("C0").alias("document_code"), (F.col("object_id") % 2 != 0).alias("parsed"), F.lit(0).alias("low_quality_pages"))
    gates = Gates(sheet_kinds={"CMP-01": ["plan", "table"], "CMP-04": ["plan"]}, min_confidence={"P0": 0.93, "default": 0.921}, equivalent_methods=[[f"m{i}" for i in range(8)]])
    found = lower(findings, fragments, gates, changes=changes, marks=marks, searched=searched)
    return found.select("finding_id", "status", F.array_join("steps", " ").alias("steps"), "change", F.array_join("flags", " ").alias("flags"))


DOORS = """
    m as (select l_orderkey // 4 as object_id, 'P' || (l_partkey % 6) as param_code, case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as st, case when l_suppkey % 5 > 0 then 'D' || (l_suppkey % 5) end as mark, case l_linenumber % 4 when 1 then 'A' when 2 then 'B' end as building,
        ['outward', 'outward', 'inward', 'sliding', 'blocks', 'hand'][cast(l_quantity as integer) % 6 + 1] as value, 1 - l_tax as confidence, cast(l_suppkey as varchar) as file_id, l_linenumber as page, l_tax > 0.03 as evac, l_discount > 0.098 as disputed,
        case when l_discount < 0.005 then 'EXEMPT' when l_discount < 0.008 then 'NOT_EVAC' when l_discount < 0.011 then 'NEGATION' end as excluded, case when l_extendedprice < 3000 then 'x' end as exemption from lineitem),
    r as (select *, coalesce(excluded = 'NEGATION', false) as unclear, coalesce(excluded = 'EXEMPT', false) or coalesce(excluded, '') <> 'NEGATION' and exemption is not null as exempt, excluded is null and value = 'hand' as silent, coalesce(excluded = 'NOT_EVAC', false) as outside,
        excluded is null and value <> 'hand' as way, value in ('inward', 'sliding') as bad from m),
    w as (select *, row_number() over (partition by object_id, param_code, st order by disputed, confidence desc, bad desc, file_id, page, value, mark nulls first, building nulls first) as no from r where way),
    d as (select * from w qualify row_number() over (partition by object_id, param_code, st, mark, building order by no) = 1),
    f as (select object_id, param_code, min(st) as fst from d group by 1, 2),
    em as (select distinct object_id, param_code, mark from r where way and evac and mark is not null),
    l as (select d.*, fst, d.evac or em.mark is not null as escape, d.param_code in ('P0', 'P1') as norm from d join f using (object_id, param_code) left join em on em.object_id = d.object_id and em.param_code = d.param_code and em.mark = d.mark where st > 1),
    g as (select l.object_id, l.param_code, l.st, l.no, min_by(b.value, b.no) filter (where b.mark = l.mark and (b.building = l.building or b.building is null or l.building is null)) as own, coalesce(bool_or(b.mark = l.mark), false) as elsewhere,
        min_by(b.value, b.no) filter (where b.mark is null and (b.building = l.building or b.building is null or l.building is null)) as general from l join d b on b.object_id = l.object_id and b.param_code = l.param_code and b.st = l.fst and l.st > l.fst group by 1, 2, 3, 4),
    o as (select l.*, own, general, case when value = 'blocks' then case when escape then 'blocks' else 'unknown' end when own is not null then 'pair' when elsewhere then 'other' when bad and not escape then case when general is not null or norm then 'unknown' else 'none' end
        when general is not null then 'pair' when norm and bad then 'norm' else 'none' end as outcome from l left join g using (object_id, param_code, st, no)),
    v as (select *, bad and (outcome = 'norm' or outcome = 'pair' and coalesce(own, general) = 'outward') as violation from o),
    x as (select object_id, param_code, bool_or(not (exemption is not null or excused)) as hard, bool_or(exemption is not null or excused) as soft from (select v.*, exists (select 1 from r e where e.exempt and e.object_id = v.object_id and e.param_code = v.param_code
        and (e.st = v.st or e.st = v.fst and v.fst < v.st) and e.mark is not distinct from v.mark) as excused from v where violation) z group by 1, 2),
    c as (select object_id, param_code, count(*) filter (where outcome = 'pair') as pairs, count(*) filter (where violation) as violations, bool_or(outcome = 'blocks') as blocks, bool_or(outcome in ('other', 'unknown')) as odd from v group by 1, 2),
    s as (select r.object_id, r.param_code, bool_or(unclear and (evac or em.mark is not null)) as lost, bool_or(silent) as silent, bool_or(outside) as outside from r left join em on em.object_id = r.object_id and em.param_code = r.param_code and em.mark = r.mark where st > 1 group by 1, 2),
    q as (select object_id, param_code, bool_or(disputed) as disputed from d group by 1, 2),
    k as (select distinct object_id, param_code from m)
"""


@query(
    "kind_direction",
    f"""
    with {DOORS}
    select object_id, param_code, case when disputed then 'CLARIFICATION_REQUIRED' when hard then 'CANDIDATE' when soft or blocks or lost then 'NOT_COMPARABLE' when pairs > 0 then 'NEGATIVE_VERIFIED' when odd or silent then 'NOT_COMPARABLE' when outside then 'NEGATIVE_VERIFIED' else 'MISSING_EVIDENCE' end as status,
        coalesce(pairs, 0) as pairs, coalesce(violations, 0) as violations from k left join q using (object_id, param_code) left join x using (object_id, param_code) left join c using (object_id, param_code) left join s using (object_id, param_code)
    """,
)
def kind_direction(spark, sf_dir):
    """Findings for the way doors on ways of escape open."""
    low = F.col("l_discount")
    excluded = F.when(low < 0.005, "EXEMPT").when(low < 0.008, "NOT_EVAC").when(low < 0.011, "NEGATION")
    value = F.get(F.array(*map(F.lit, ("outward", "outward", "inward", "sliding", "blocks", "hand"))), F.col("l_quantity").cast("int") % 6)
    stage = F.when(F.col("l_returnflag") == "A", "PD").when(F.col("l_returnflag") == "N", "RD").otherwise("ID")
    keys = {"object_id": F.floor(F.col("l_orderkey") / 4), "param_code": F.concat(F.lit("P"), (F.col("l_partkey") % 6).cast("string"))}
    mentions = dealt(table(spark, sf_dir, "lineitem").withColumns(keys), *keys, rows=200_000).select(
        *keys, stage.alias("stage"),
        F.when(F.col("l_suppkey") % 5 > 0, F.concat(F.lit("D"), (F.col("l_suppkey") % 5).cast("string"))).alias("mark"), F.when(F.col("l_linenumber") % 4 == 1, "A").when(F.col("l_linenumber") % 4 == 2, "B").alias("building"),
        value.alias("value"), (1 - F.col("l_tax")).alias("confidence"), F.col("l_suppkey").cast("string").alias("file_id"), F.col("l_linenumber").alias("page"), (F.col("l_tax") > 0.03).alias("evac"),
        F.when(low > 0.098, "CONFLICT").otherwise("CURRENT").alias("role"), excluded.alias("excluded"), F.when(F.col("l_extendedprice") < 3000, "x").alias("exemption"), F.lit("A").alias("discipline"),
    )
    params = spark.createDataFrame([(f"P{i}", "direction", {s: ["B", "*"] for s in ("PD", "RD", "ID")}, i < 2) for i in range(6)], "param_code string, kind string, sources map<string,array<string>>, norm boolean")
    return kinds.evaluate("direction", mentions, params)
