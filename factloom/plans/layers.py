"""The kind of layered constructions over the test tables: line items are layers of stacks in three stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import kinds
from factloom.kinds.layers import layer_conflicts, layer_operations
from factloom.operators.stacks import LAYERS
from factloom.plans.registry import query
from factloom.sources.tables import dealt, table

GROUPS = {"M0": "soft", "M1": "soft", "M2": "hard", "M3": "hard"}
ANALOGS = [("M0", "M1", "EQUIVALENT"), ("M1", "M0", "NOT_EQUIVALENT"), ("M2", "M3", "EQUIVALENT")]

#: Layers of mentions with runs of one material merged, mentions numbered by priority, and the pairs of their stacks.
STACKS = """
    x as (select l_orderkey // 8 as object_id, 'L' || (l_orderkey % 2) as param_code, case l_returnflag when 'A' then 'PD' when 'N' then 'RD' else 'ID' end as stage,
        case l_partkey % 4 when 0 then 'A-1' when 1 then 'a 1' when 2 then 'B' end as item, case when l_partkey % 4 = 3 then '0' else cast(l_suppkey % 2 as varchar) end as file_id,
        l_orderkey, l_linenumber, l_discount, l_tax, case when l_partkey % 5 < 4 then 'M' || (l_partkey % 5) else '~x' || (l_suppkey % 3) end as name, l_partkey % 5 < 4 as known,
        case when l_linenumber <> 5 then cast(l_quantity as integer) % 4 * 10 end as t from lineitem),
    y as (select *, case when lag(name) over w = name then 0 else 1 end as starts from x window w as (partition by object_id, param_code, stage, item, file_id order by l_orderkey, l_linenumber, name, t nulls first)),
    z as (select *, sum(starts) over (partition by object_id, param_code, stage, item, file_id order by l_orderkey, l_linenumber, name, t nulls first) as run from y),
    zz as (select * exclude (run), run * 1000 + case when known then 0 else (row_number() over (partition by object_id, param_code, stage, item, file_id, run order by l_orderkey, l_linenumber, name, t nulls first) - 1) // 2 end as run from z),
    r as (select object_id, param_code, stage, item, file_id, run, any_value(name) as single, case when any_value(known) then any_value(name) else '~' || repeat(any_value(name)[2:], count(*)) end as name, any_value(known) as known, case when count(t) = count(*) then sum(t) end as t from zz group by 1, 2, 3, 4, 5, 6),
    g as (select object_id, param_code, stage, item, file_id, list(struct_pack(name := name, known := known, t := t) order by run) as layers, list(distinct single) as singles from r group by 1, 2, 3, 4, 5),
    h as (select object_id, param_code, stage, item, file_id, max(1 - l_tax) as confidence, bool_or(l_discount > 0.098) as disputed, min(l_linenumber) as page from x group by 1, 2, 3, 4, 5),
    u as (select g.object_id, g.param_code, g.stage, lower(replace(replace(g.item, '-', ''), ' ', '')) as mark, g.file_id, disputed, layers, singles,
        row_number() over (partition by g.object_id, g.param_code, g.stage order by disputed, confidence desc, g.file_id, page, g.item nulls first) as no
        from g join h on g.object_id = h.object_id and g.param_code = h.param_code and g.stage = h.stage and g.item is not distinct from h.item and g.file_id = h.file_id),
    f as (select * from u qualify mark is null or row_number() over (partition by object_id, param_code, stage, mark order by no) = 1),
    s as (select distinct object_id, param_code, stage from f where stage <> 'PD'),
    m as (select b.object_id, b.param_code, a.stage, b.no as before_no, a.no as after_no from f b join f a on a.object_id = b.object_id and a.param_code = b.param_code and a.stage <> 'PD' and b.stage = 'PD' and a.mark = b.mark),
    lb as (select s.object_id, s.param_code, s.stage, b.no, b.mark, b.singles from f b join s on b.object_id = s.object_id and b.param_code = s.param_code and b.stage = 'PD'
        where not exists (select 1 from m where m.object_id = s.object_id and m.param_code = s.param_code and m.stage = s.stage and m.before_no = b.no)),
    la as (select * from f a where stage <> 'PD' and not exists (select 1 from m where m.object_id = a.object_id and m.param_code = a.param_code and m.stage = a.stage and m.after_no = a.no)),
    k as (select lb.object_id, lb.param_code, lb.stage, lb.no as before_no, la.no as after_no, lb.mark as before_mark, la.mark as after_mark,
        lb.singles as ns, la.singles as ms,
        count(*) over (partition by lb.object_id, lb.param_code, lb.stage, la.no) as nb, count(*) over (partition by lb.object_id, lb.param_code, lb.stage, lb.no) as na
        from lb join la on lb.object_id = la.object_id and lb.param_code = la.param_code and lb.stage = la.stage),
    k2 as (select *, len(list_intersect(ns, ms)) / len(list_distinct(list_concat(ns, ms))) as similarity from k),
    one as (select object_id, param_code, stage, before_no, after_no from k2 where na = 1 and nb = 1 and (before_mark is null or after_mark is null or similarity >= 0.5)),
    near as (select object_id, param_code, stage, before_no, after_no from k2 where after_mark is null and similarity >= 0.5
        and not exists (select 1 from one where one.object_id = k2.object_id and one.param_code = k2.param_code and one.stage = k2.stage)
        qualify row_number() over (partition by object_id, param_code, stage order by similarity desc, coalesce(before_mark, '~'), after_no) = 1),
    q as (select * from m union all select * from one union all select * from near),
    p as (select row_number() over () as pid, q.*, b.layers as a, c.layers as b from q join u b on b.object_id = q.object_id and b.param_code = q.param_code and b.stage = 'PD' and b.no = before_no
        join u c on c.object_id = q.object_id and c.param_code = q.param_code and c.stage = q.stage and c.no = after_no),
"""
#: Every path through the table of a pair is walked from its end; the best is the first of equals by its letters.
OPERATIONS = """
    w(pid, i, j, path, score) as (select pid, len(a), len(b), '', 0 from p union all
        select w.pid, i - case when op <> 'I' then 1 else 0 end, j - case when op <> 'X' then 1 else 0 end, path || op,
            score + case when op <> 'D' then -2 when a[i].name = b[j].name then 3 when not a[i].known or not b[j].known then 0 when (a[i].name in ('M0', 'M1')) = (b[j].name in ('M0', 'M1')) then 1 else -5 end
        from w join p using (pid), (values ('D'), ('I'), ('X')) o(op) where (op <> 'D' or i > 0 and j > 0) and (op <> 'I' or j > 0) and (op <> 'X' or i > 0)),
    best as (select pid, path from w where i = 0 and j = 0 qualify row_number() over (partition by pid order by score desc, path) = 1),
    st as (select pid, path, unnest(range(1, len(path) + 1)) as k from best),
    pl as (select pid, len(path) - k as step, path[k] as op, case when path[k] <> 'I' then len(replace(path[k:], 'I', '')) end as i, case when path[k] <> 'X' then len(replace(path[k:], 'X', '')) end as j from st),
    al as (select pl.*, case when i is not null then a[i] end as was, case when j is not null then b[j] end as now from pl join p using (pid)),
    mv as (select x.pid, x.step, y.step as to_step, y.j as to_j, y.now as to_now from (select *, row_number() over (partition by pid, was.name order by step) as n from al where op = 'X') x
        join (select *, row_number() over (partition by pid, now.name order by step) as n from al where op = 'I') y on x.pid = y.pid and x.was.name = y.now.name and x.n = y.n),
    fin as (select al.pid, al.step, al.i, coalesce(al.j, to_j) as j, al.was, coalesce(al.now, to_now) as now, to_j is not null as moved from al left join mv on al.pid = mv.pid and al.step = mv.step
        where not exists (select 1 from mv v where v.pid = al.pid and v.to_step = al.step)),
    op1 as (select *, case when now is not null and was is not null then now.t - was.t end as d, was.name || now.name in ('M0M1', 'M2M3') as eq, coalesce(not was.known or not now.known, false) as unk from fin),
    op2 as (select pid, step, i - 1 as before_at, j - 1 as after_at, unk, eq, unnest(list_filter([case when now is null then 'delete_layer' when was is null then 'insert_layer' when moved then 'reorder'
          when was.name = now.name then case when d is null or abs(d) <= 5 then 'match' end else 'substitute_material' end,
        case when was is not null and now is not null and (was.name = now.name or not unk and eq) then case when d < -5 then 'thickness_down' when d > 5 then 'thickness_up' end end], lambda v: v is not null)) as op from op1),
    ops as (select *, op in ('delete_layer', 'thickness_down', 'reorder') or op = 'substitute_material' and not unk and not eq as violation, op = 'substitute_material' and unk as uncertain from op2)
"""


def _inputs(spark, sf_dir):
    part = F.col("l_partkey")
    item = F.when(part % 4 == 0, "A-1").when(part % 4 == 1, "a 1").when(part % 4 == 2, "B")
    stage = F.when(F.col("l_returnflag") == "A", "PD").when(F.col("l_returnflag") == "N", "RD").otherwise("ID")
    layer = F.struct(
        F.when(part % 5 < 4, F.concat(F.lit("M"), (part % 5).cast("string"))).alias("m"), F.concat(F.lit("X "), (F.col("l_suppkey") % 3).cast("string")).alias("raw"),
        F.when(F.col("l_linenumber") != 5, F.col("l_quantity").cast("int") % 4 * 10).cast("double").alias("t"),
    )
    name = F.when(part % 5 < 4, F.concat(F.lit("M"), (part % 5).cast("string"))).otherwise(F.concat(F.lit("~x"), (F.col("l_suppkey") % 3).cast("string")))
    keys = {"object_id": F.floor(F.col("l_orderkey") / 8), "param_code": F.concat(F.lit("L"), (F.col("l_orderkey") % 2).cast("string"))}
    rows = dealt(table(spark, sf_dir, "lineitem").withColumns(keys), *keys, rows=200_000).select(
        *keys, stage.alias("stage"), item.alias("item"),
        F.when(part % 4 == 3, "0").otherwise((F.col("l_suppkey") % 2).cast("string")).alias("file_id"), "l_discount", "l_tax", "l_linenumber",
        F.struct("l_orderkey", "l_linenumber", name.alias("name"), layer.t.alias("t"), layer.alias("layer")).alias("place"),
    )
    mentions = rows.groupBy("object_id", "param_code", "stage", "item", "file_id").agg(
        F.transform(F.array_sort(F.collect_list("place")), lambda p: p["layer"]).cast(LAYERS).alias("layers"), F.max(1 - F.col("l_tax")).alias("confidence"),
        F.when(F.bool_or(F.col("l_discount") > 0.098), "CONFLICT").otherwise("CURRENT").alias("role"), F.min("l_linenumber").alias("page"),
    )
    params = spark.createDataFrame([(f"L{i}", "layers", 5.0) for i in (0, 1)], "param_code string, kind string, tolerance double")
    return mentions, params, spark.createDataFrame(ANALOGS, "was string, now string, verdict string")


@query(
    "kind_layers",
    f"""
    with recursive {STACKS} {OPERATIONS},
    d as (select object_id, param_code, bool_or(stage = 'PD') as design, bool_or(stage <> 'PD') as later, bool_or(disputed) as disputed from u group by 1, 2),
    n as (select object_id, param_code, count(*) as pairs from p group by 1, 2),
    c as (select object_id, param_code, count(*) as operations, count(*) filter (where violation) as violations, count(*) filter (where uncertain) as unsure,
        min(case op when 'delete_layer' then 1 when 'substitute_material' then 2 when 'thickness_down' then 3 else 4 end) filter (where violation) as worst from ops join p using (pid) group by 1, 2),
    v as (select d.object_id, d.param_code, coalesce(pairs, 0) as pairs, coalesce(operations, 0) as operations, coalesce(violations, 0) as violations, worst,
        case when disputed then 'CLARIFICATION_REQUIRED' when not design or not later then 'MISSING_EVIDENCE' when pairs is null then 'NOT_COMPARABLE' when violations > 0 then 'CANDIDATE' when unsure > 0 then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status
        from d left join n using (object_id, param_code) left join c using (object_id, param_code))
    select object_id, param_code, status, pairs, operations, violations, case when status = 'CANDIDATE' then ['delete_layer', 'substitute_material', 'thickness_down', 'reorder'][worst] end as worst from v
    """,
)
def kind_layers(spark, sf_dir):
    """Findings for stacks of layers."""
    mentions, params, analogs = _inputs(spark, sf_dir)
    return kinds.evaluate("layers", mentions, params, analogs=analogs, groups=GROUPS)


@query(
    "layer_operations",
    f"""
    with recursive {STACKS} {OPERATIONS}
    select object_id, param_code, stage, before_no, after_no, step, op, before_at, after_at, violation, uncertain from ops join p using (pid)
    """,
    casts={"before_no": "integer", "after_no": "integer", "step": "integer", "before_at": "integer", "after_at": "integer"},
)
def layer_operations_query(spark, sf_dir):
    """What turns each stack into that of the later stage, operation by operation."""
    mentions, params, analogs = _inputs(spark, sf_dir)
    return layer_operations(mentions, params, analogs, GROUPS)


@query(
    "layer_conflicts",
    f"""
    with recursive {STACKS.replace("    p as (select row_number()", "    p0 as (select row_number()")}
    p as (select row_number() over () as pid, a.object_id, a.param_code, a.stage, a.mark, a.file_id, f.layers as a, a.layers as b
        from u a join f on a.object_id = f.object_id and a.param_code = f.param_code and a.stage = f.stage and a.mark = f.mark and a.file_id <> f.file_id),
    {OPERATIONS}
    select object_id, param_code, stage, mark, count(distinct file_id) + 1 as documents from ops join p using (pid) where op <> 'match' group by 1, 2, 3, 4
    """,
)
def layer_conflicts_query(spark, sf_dir):
    """Marks whose stacks a stage's documents give differently."""
    mentions, params, analogs = _inputs(spark, sf_dir)
    return layer_conflicts(mentions, params, analogs, GROUPS)
