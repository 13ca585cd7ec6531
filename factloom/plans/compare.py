"""Stage comparison: one value per stage is picked, the earliest is the baseline, and a ladder gives the status."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.compare import allowed, breaks, compare, ladder, numeric_suffix, ordinal, scale_mismatch, severity, violates
from factloom.operators.picks import first_per, islands, running_offset, source_rank, tier_filter, whole_groups
from factloom.plans.registry import query
from factloom.plans.views import MENTIONS_SQL, STAGES, mentions
from factloom.sources.tables import table

SOURCES = ["S2", "S0", "*"]
PICKED_SQL = f"""
(select * from (select *, row_number() over (partition by param, stage order by
     case source when 'S2' then 0 when 'S0' then 1 else 2 end, case role when 'CURRENT' then 0 else 1 end,
     confidence desc, file_id, page, supplier, num, price) as rn from {MENTIONS_SQL} m) t where rn = 1)
"""


def picked(spark, sf_dir):
    """One value per parameter and stage: source rank, role, confidence, file, page."""
    order = [source_rank(F.col("source"), SOURCES), F.when(F.col("role") == "CURRENT", 0).otherwise(1), F.desc("confidence"), "file_id", "page", "supplier", "num", "price"]
    return first_per(mentions(spark, sf_dir), ["param", "stage"], order)


def by_stage(rows, *values):
    """Pivot values of the three stages into columns, one row per parameter, in a single aggregate."""
    cells = [F.max(F.when(F.col("stage") == s, F.col(v))).alias(f"{s.lower()}_{v}") for s in STAGES for v in values]
    return rows.groupBy("param").agg(F.count("*").alias("n_stages"), F.bool_or("disputed").alias("any_disputed"), *cells)


PIVOT_SQL = f"""
(select param, count(*) as n_stages, bool_or(disputed) as any_disputed,
        max(case when stage = 'PD' then num end) as pd_num, max(case when stage = 'RD' then num end) as rd_num,
        max(case when stage = 'ID' then num end) as id_num from {PICKED_SQL} p group by param)
"""


@query("pick_stage_value", f"select param, stage, num, file_id, page, source, role from {PICKED_SQL} p")
def pick_stage_value(spark, sf_dir):
    return picked(spark, sf_dir).select("param", "stage", "num", "file_id", "page", "source", "role")


@query(
    "evaluate_generic",
    f"""
    with v as (select s.*, p_size % 6 as k, p_type from {PIVOT_SQL} s join part on p_partkey = param),
    f as (select *, coalesce(pd_num, rd_num) as base,
        case k when 0 then 'equal' when 1 then 'delta_pct' when 2 then 'decrease' when 3 then 'increase' when 4 then 'min' else 'max' end as kind from v),
    b as (select *,
      case kind when 'min' then pd_num < 10 - 1e-9 when 'max' then pd_num > 40 + 1e-9 end as pd_bad,
      case kind when 'equal' then rd_num <> pd_num when 'delta_pct' then abs(rd_num - pd_num) / abs(pd_num) * 100 > 50 + 1e-9
           when 'decrease' then rd_num < pd_num - 1e-9 when 'increase' then rd_num > pd_num + 1e-9
           when 'min' then rd_num < 10 - 1e-9 when 'max' then rd_num > 40 + 1e-9 end as rd_bad,
      case kind when 'equal' then id_num <> base when 'delta_pct' then abs(id_num - base) / abs(base) * 100 > 50 + 1e-9
           when 'decrease' then id_num < base - 1e-9 when 'increase' then id_num > base + 1e-9
           when 'min' then id_num < 10 - 1e-9 when 'max' then id_num > 40 + 1e-9 end as id_bad from f)
    select param, kind,
      case when p_type = 'PROMO' then 'NOT_APPLICABLE' when any_disputed then 'CLARIFICATION_REQUIRED'
           when kind not in ('min', 'max') and n_stages < 2 then 'MISSING_EVIDENCE'
           when coalesce(pd_bad, false) or coalesce(rd_bad, false) or coalesce(id_bad, false) then 'CANDIDATE'
           else 'NEGATIVE_VERIFIED' end as status,
      case when coalesce(id_bad, false) then 'ID' when coalesce(rd_bad, false) then 'RD' when coalesce(pd_bad, false) then 'PD' end as worst_stage
    from b
    """,
)
def evaluate_generic(spark, sf_dir):
    """Six rules; thresholds hold for each stage, the others against the earliest; the last bad stage explains it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("param"), "p_type", (F.col("p_size") % 6).alias("k"))
    kinds = F.array(*map(F.lit, ("equal", "delta_pct", "decrease", "increase", "min", "max")))
    rows = by_stage(picked(spark, sf_dir), "num").join(part, "param").withColumn("kind", F.element_at(kinds, F.col("k") + 1))
    base = F.coalesce("pd_num", "rd_num")
    threshold = F.col("kind").isin("min", "max")

    def bad(value, expected):
        return F.coalesce(violates(F.col("kind"), expected, value, F.lit(50.0), F.lit(10.0), F.lit(40.0)), F.lit(False))

    pd_bad, rd_bad, id_bad = threshold & bad(F.col("pd_num"), base), bad(F.col("rd_num"), F.col("pd_num")), bad(F.col("id_num"), base)
    status = ladder(
        (F.col("p_type") == "PROMO", "NOT_APPLICABLE"),
        (F.col("any_disputed"), "CLARIFICATION_REQUIRED"),
        (~threshold & (F.col("n_stages") < 2), "MISSING_EVIDENCE"),
        (pd_bad | rd_bad | id_bad, "CANDIDATE"),
        otherwise="NEGATIVE_VERIFIED",
    )
    worst = F.when(id_bad, "ID").when(rd_bad, "RD").when(pd_bad, "PD")
    return rows.select("param", "kind", status.alias("status"), worst.alias("worst_stage"))


@query(
    "evaluate_quantity",
    f"""
    with f as (select *, greatest(3.0, abs(pd_num) * 10 / 100) as tol,
        case when pd_num > 0 and rd_num > 0 then greatest(pd_num, rd_num) / least(pd_num, rd_num) between 5 and 15
             or greatest(pd_num, rd_num) / least(pd_num, rd_num) between 500 and 1500 else false end as scaled from {PIVOT_SQL} s)
    select param, case when any_disputed then 'CLARIFICATION_REQUIRED' when n_stages < 2 or pd_num is null then 'MISSING_EVIDENCE'
        when scaled then 'NOT_COMPARABLE'
        when coalesce(pd_num - rd_num > tol + 1e-9, false) or coalesce(pd_num - id_num > tol + 1e-9, false) then 'CANDIDATE'
        else 'NEGATIVE_VERIFIED' end as status,
      case when coalesce(abs(id_num - pd_num), -1) >= coalesce(abs(rd_num - pd_num), -1) then id_num else rd_num end as farthest
    from f
    """,
)
def evaluate_quantity(spark, sf_dir):
    """A decrease beyond max(absolute, relative) tolerance; values in another unit can't be compared."""
    rows = by_stage(picked(spark, sf_dir), "num")
    pd, rd, id_ = F.col("pd_num"), F.col("rd_num"), F.col("id_num")
    tolerance = allowed(F.lit(3.0), F.lit(10.0), pd)
    bad = F.coalesce(breaks("decrease", pd, rd, tolerance), F.lit(False)) | F.coalesce(breaks("decrease", pd, id_, tolerance), F.lit(False))
    status = ladder(
        (F.col("any_disputed"), "CLARIFICATION_REQUIRED"),
        ((F.col("n_stages") < 2) | pd.isNull(), "MISSING_EVIDENCE"),
        (scale_mismatch(pd, rd, [10.0, 1000.0]), "NOT_COMPARABLE"),
        (bad, "CANDIDATE"),
        otherwise="NEGATIVE_VERIFIED",
    )
    far = lambda x: F.coalesce(F.abs(x - pd), F.lit(-1.0))
    return rows.select("param", status.alias("status"), F.when(far(id_) >= far(rd), id_).otherwise(rd).alias("farthest"))


@query(
    "evaluate_quantity_objects",
    f"""
    with o as (select param, supplier % 3 as object, min(case when stage = 'PD' then num end) as pd, max(case when stage <> 'PD' then num end) as later,
                      bool_or(disputed) as disputed from {MENTIONS_SQL} m group by param, supplier % 3),
    s as (select *, case when disputed then 'CLARIFICATION_REQUIRED' when pd is null or later is null then 'MISSING_EVIDENCE'
                         when later - pd > 30 + 1e-9 then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as status from o),
    r as (select *, case status when 'CANDIDATE' then 1 when 'CLARIFICATION_REQUIRED' then 2 when 'NOT_COMPARABLE' then 3
                         when 'NEGATIVE_VERIFIED' then 4 else 5 end as sev from s)
    select param, arg_min(status, sev * 10 + object) as status, arg_min(object, sev * 10 + object) as object, count(*) as n_objects from r group by param
    """,
)
def evaluate_quantity_objects(spark, sf_dir):
    """Each marked object on its own, the worst status for the parameter."""
    rows = mentions(spark, sf_dir).withColumn("object", F.col("supplier") % 3)
    pd, later = F.min(F.when(F.col("stage") == "PD", F.col("num"))), F.max(F.when(F.col("stage") != "PD", F.col("num")))
    objects = rows.groupBy("param", "object").agg(pd.alias("pd"), later.alias("later"), F.bool_or("disputed").alias("disputed"))
    status = ladder(
        (F.col("disputed"), "CLARIFICATION_REQUIRED"),
        (F.col("pd").isNull() | F.col("later").isNull(), "MISSING_EVIDENCE"),
        (breaks("increase", F.col("pd"), F.col("later"), F.lit(30.0)), "CANDIDATE"),
        otherwise="NEGATIVE_VERIFIED",
    )
    judged = objects.withColumn("status", status)
    worst = F.struct(severity(F.col("status")), "object")
    return judged.groupBy("param").agg(F.min_by("status", worst).alias("status"), F.min_by("object", worst).alias("object"), F.count("*").alias("n_objects"))


@query(
    "evaluate_class",
    """
    with v as (select o_custkey, case o_orderstatus when 'F' then 'PD' when 'O' then 'RD' else 'ID' end as stage,
                 case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 3 end as r,
                 o_orderdate, o_orderkey from orders),
    p as (select * from (select *, row_number() over (partition by o_custkey, stage order by o_orderdate desc,
              case when stage = 'PD' then r else -r end asc nulls last, o_orderkey) as rn from v) t where rn = 1),
    w as (select o_custkey, count(*) as n, max(case when stage = 'PD' then r end) as pd, max(case when stage = 'RD' then r end) as rd,
                 max(case when stage = 'ID' then r end) as id from p group by o_custkey)
    select o_custkey, case when n < 2 then 'MISSING_EVIDENCE' when pd is null or (rd is null and id is null) then 'NOT_COMPARABLE'
             when coalesce(rd > pd, false) or coalesce(id > pd, false) then 'CANDIDATE'
             when (rd is null or id is null) and n = 3 then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status,
           greatest(coalesce(rd - pd, 0), coalesce(id - pd, 0)) as drop_steps
    from w
    """,
    {"drop_steps": "bigint"},
)
def evaluate_class(spark, sf_dir):
    """Ordinal classes: on ties the best of the design and the worst of later stages; off the scale is incomparable."""
    rank = ordinal(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    stage = F.when(F.col("o_orderstatus") == "F", "PD").when(F.col("o_orderstatus") == "O", "RD").otherwise("ID")
    rows = table(spark, sf_dir, "orders").select("o_custkey", stage.alias("stage"), rank.alias("r"), "o_orderdate", "o_orderkey")
    side = F.when(F.col("stage") == "PD", F.col("r")).otherwise(-F.col("r"))
    chosen = first_per(rows, ["o_custkey", "stage"], [F.desc("o_orderdate"), side.asc_nulls_last(), F.asc("o_orderkey")])
    cell = lambda s: F.max(F.when(F.col("stage") == s, F.col("r"))).alias(s.lower())
    wide = chosen.groupBy("o_custkey").agg(F.count("*").alias("n"), *map(cell, STAGES))
    pd, rd, id_ = F.col("pd"), F.col("rd"), F.col("id")
    status = ladder(
        (F.col("n") < 2, "MISSING_EVIDENCE"),
        (pd.isNull() | (rd.isNull() & id_.isNull()), "NOT_COMPARABLE"),
        ((rd > pd) | (id_ > pd), "CANDIDATE"),
        ((rd.isNull() | id_.isNull()) & (F.col("n") == 3), "NOT_COMPARABLE"),
        otherwise="NEGATIVE_VERIFIED",
    )
    drop = F.greatest(F.coalesce(rd - pd, F.lit(0)), F.coalesce(id_ - pd, F.lit(0)))
    return wide.select("o_custkey", status.alias("status"), drop.alias("drop_steps"))


@query(
    "evaluate_count",
    f"""
    with c as (select param, stage, count(distinct page) as n, min(page) as low, max(page) as high,
                      count(distinct floor(num / 25)) > 1 as inside from {MENTIONS_SQL} m group by param, stage),
    w as (select param, count(*) as stages, min(low) as lo, max(low) as hi, bool_or(inside) as double_count,
                 arg_max(stage, abs(low - 1) * 10 + case stage when 'PD' then 3 when 'RD' then 2 else 1 end) as farthest from c group by param)
    select param, farthest, hi - lo as spread, case when stages < 2 then 'MISSING_EVIDENCE' when lo = hi then 'NEGATIVE_VERIFIED'
           when double_count then 'CLARIFICATION_REQUIRED' else 'CANDIDATE' end as status from w
    """,
)
def evaluate_count(spark, sf_dir):
    """Any difference counts; disagreement inside a stage (double count) lowers it to a question."""
    stages = mentions(spark, sf_dir).groupBy("param", "stage").agg(
        F.min("page").alias("low"), (F.countDistinct(F.floor(F.col("num") / 25)) > 1).alias("inside")
    )
    place = F.when(F.col("stage") == "PD", 3).when(F.col("stage") == "RD", 2).otherwise(1)
    wide = stages.groupBy("param").agg(
        F.count("*").alias("stages"),
        F.min("low").alias("lo"),
        F.max("low").alias("hi"),
        F.bool_or("inside").alias("double_count"),
        F.max_by("stage", F.struct(F.abs(F.col("low") - 1), place)).alias("farthest"),
    )
    status = ladder(
        (F.col("stages") < 2, "MISSING_EVIDENCE"),
        (F.col("lo") == F.col("hi"), "NEGATIVE_VERIFIED"),
        (F.col("double_count"), "CLARIFICATION_REQUIRED"),
        otherwise="CANDIDATE",
    )
    return wide.select("param", "farthest", (F.col("hi") - F.col("lo")).alias("spread"), status.alias("status"))


@query(
    "evaluate_presence",
    f"""
    with s as (select param, stage, bool_or(num > 25) as present, bool_or(num <= 25) as absent from {MENTIONS_SQL} m group by param, stage),
    t as (select param, stage, case when present and absent then 'MIXED' when present then 'PRESENT' else 'ABSENT' end as state from s),
    w as (select part.p_partkey as param, coalesce(max(case when stage = 'PD' then state end), 'SILENT') as pd,
                 coalesce(max(case when stage = 'RD' then state end), 'SILENT') as rd, coalesce(max(case when stage = 'ID' then state end), 'SILENT') as id
          from part left join t on t.param = p_partkey group by part.p_partkey)
    select param, pd, rd, id, case when pd in ('SILENT', 'ABSENT') then 'NOT_APPLICABLE' when pd = 'MIXED' then 'NOT_COMPARABLE'
        when rd = 'ABSENT' or id = 'ABSENT' then 'CANDIDATE' when rd = 'MIXED' or id = 'MIXED' then 'NOT_COMPARABLE'
        when rd = 'SILENT' or id = 'SILENT' then 'MISSING_EVIDENCE' else 'NEGATIVE_VERIFIED' end as status from w
    """,
)
def evaluate_presence(spark, sf_dir):
    """Presence by aspect: silence is never a violation, a mixed stage can't be compared."""
    rows = mentions(spark, sf_dir)
    flags = rows.groupBy("param", "stage").agg(F.bool_or(F.col("num") > 25).alias("present"), F.bool_or(F.col("num") <= 25).alias("absent"))
    state = F.when(F.col("present") & F.col("absent"), "MIXED").when(F.col("present"), "PRESENT").otherwise("ABSENT")
    cell = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, state)), F.lit("SILENT")).alias(s.lower())
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("param"))
    wide = parts.join(flags, "param", "left").groupBy("param").agg(*map(cell, STAGES))
    pd = F.col("pd")
    later = lambda s: (F.col("rd") == s) | (F.col("id") == s)
    status = ladder(
        (pd.isin("SILENT", "ABSENT"), "NOT_APPLICABLE"),
        (pd == "MIXED", "NOT_COMPARABLE"),
        (later("ABSENT"), "CANDIDATE"),
        (later("MIXED"), "NOT_COMPARABLE"),
        (later("SILENT"), "MISSING_EVIDENCE"),
        otherwise="NEGATIVE_VERIFIED",
    )
    return wide.select("param", "pd", "rd", "id", status.alias("status"))


@query(
    "evaluate_substitution",
    """
    with d as (select * from (select l_orderkey, p_type as item, p_brand as mark, l_returnflag as stage,
                 row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey) as rn
               from lineitem join part on l_partkey = p_partkey) t where rn = 1),
    j as (select a.l_orderkey, a.mark as was, b.mark as now,
            case when a.mark = b.mark then 'SAME' when a.item = b.item and cast(substring(a.mark, 7) as int) // 5 = cast(substring(b.mark, 7) as int) // 5 then 'EQUIVALENT'
                 when a.item = b.item then 'NOT_EQUIVALENT' else 'UNKNOWN' end as decision
          from d a join d b on a.l_orderkey = b.l_orderkey and a.stage = 'A' and b.stage = 'R')
    select l_orderkey, was, now, decision, case decision when 'NOT_EQUIVALENT' then 'CANDIDATE' when 'UNKNOWN' then 'NOT_COMPARABLE' else 'NEGATIVE_VERIFIED' end as status from j
    """,
)
def evaluate_substitution(spark, sf_dir):
    """A product replaced by another: the same, an analogue of the same group, or neither."""
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    first = first_per(rows, ["l_orderkey", "l_returnflag"], [F.asc("l_linenumber"), F.asc("l_partkey")])
    side = lambda s, item, mark: first.where(F.col("l_returnflag") == s).select("l_orderkey", F.col("p_type").alias(item), F.col("p_brand").alias(mark))
    pairs = side("A", "item_was", "was").join(side("R", "item_now", "now"), "l_orderkey")
    group = lambda c: F.floor(numeric_suffix(F.col(c)) / 5)
    same_item = F.col("item_was") == F.col("item_now")
    decision = F.when(F.col("was") == F.col("now"), "SAME").when(same_item & (group("was") == group("now")), "EQUIVALENT").when(same_item, "NOT_EQUIVALENT").otherwise("UNKNOWN")
    status = F.when(F.col("decision") == "NOT_EQUIVALENT", "CANDIDATE").when(F.col("decision") == "UNKNOWN", "NOT_COMPARABLE").otherwise("NEGATIVE_VERIFIED")
    return pairs.withColumn("decision", decision).select("l_orderkey", "was", "now", "decision", status.alias("status"))


@query(
    "rule_predicates",
    """
    with r(rule_id, op, bound) as (values (1, '>', 300.0), (2, '>=', 250.0), (3, '<', 1.0), (4, '<=', 0.5), (5, '==', 6.55), (6, '!=', 6.55), (7, '~', 1.0))
    select rule_id, count(*) filter (where case op when '>' then value > bound when '>=' then value >= bound when '<' then value < bound
       when '<=' then value <= bound when '==' then value = bound when '!=' then value <> bound end) as holds,
       count(*) filter (where op = '~') as unknown from events cross join r group by rule_id
    """,
)
def rule_predicates(spark, sf_dir):
    """The comparator over rules as rows; an unknown operator decides nothing."""
    rules = [(1, ">", 300.0), (2, ">=", 250.0), (3, "<", 1.0), (4, "<=", 0.5), (5, "==", 6.55), (6, "!=", 6.55), (7, "~", 1.0)]
    cells = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(op).alias("op"), F.lit(b).alias("bound")) for i, op, b in rules])
    rows = table(spark, sf_dir, "events").select("value", F.inline(cells))
    holds = compare(F.col("value"), F.col("op"), F.col("bound"))
    return rows.groupBy("rule_id").agg(F.count_if(holds).alias("holds"), F.count_if(holds.isNull()).alias("unknown"))


@query(
    "stage_source_tiers",
    f"""
    with t as (select *, case when source = 'S3' and role = 'CURRENT' then 0 when source = 'S3' then 1 else 2 end as tier from {MENTIONS_SQL} m)
    select param, stage, tier, count(*) as n, max(num) as most from (select *, min(tier) over (partition by param, stage) as best from t) x
    where tier = best group by param, stage, tier
    """,
)
def stage_source_tiers(spark, sf_dir):
    """Sources by fallback rounds: rows of the best round a stage has."""
    tier = F.when((F.col("source") == "S3") & (F.col("role") == "CURRENT"), 0).when(F.col("source") == "S3", 1).otherwise(2)
    kept = tier_filter(mentions(spark, sf_dir).withColumn("tier", tier), ["param", "stage"], F.col("tier"))
    return kept.groupBy("param", "stage", "tier").agg(F.count("*").alias("n"), F.max("num").alias("most"))


@query(
    "prefer_corrections",
    f"""
    select param, stage, count(*) as n, sum(num) as total from (select *, max(case when confidence < 0.93 then file_id end) over (partition by param, stage) as corr from {MENTIONS_SQL} m) t
    where corr is null or file_id = corr group by param, stage
    """,
)
def prefer_corrections(spark, sf_dir):
    """Only the latest correction of a stage, if it has any."""
    latest = F.max(F.when(F.col("confidence") < 0.93, F.col("file_id"))).over(W.partitionBy("param", "stage"))
    kept = mentions(spark, sf_dir).withColumn("corr", latest).where("corr is null or file_id = corr")
    return kept.groupBy("param", "stage").agg(F.count("*").alias("n"), F.sum("num").alias("total"))


@query(
    "pick_whole_document",
    f"""
    with c as (select *, count(*) over (partition by param, stage, file_id) as n, min(case source when 'S2' then 0 when 'S0' then 1 else 2 end) over (partition by param, stage, file_id) as r from {MENTIONS_SQL} m),
    d as (select *, dense_rank() over (partition by param, stage order by r, n desc, file_id) as k from c)
    select param, stage, file_id, count(*) as rows_kept, sum(num) as total from d where k = 1 group by param, stage, file_id
    """,
)
def pick_whole_document(spark, sf_dir):
    """A schedule is taken whole from one document: source rank, more rows, file."""
    best = F.min(source_rank(F.col("source"), SOURCES)).over(W.partitionBy("param", "stage", "file_id"))
    kept = whole_groups(mentions(spark, sf_dir).withColumn("r", best), ["param", "stage"], "file_id", [F.asc("r")])
    return kept.groupBy("param", "stage", "file_id").agg(F.count("*").alias("rows_kept"), F.sum("num").alias("total"))


@query(
    "stage_score",
    f"""
    with s as (select *, case when role = 'CURRENT' then 10 else 0 end + case when source = 'S1' then 2 else 0 end + case when num is not null then 1 else 0 end as score,
                 bool_or(disputed) over (partition by param, stage) as any_disputed from {MENTIONS_SQL} m)
    select param, stage, max(score) as best, arg_max(num, score * 1e9 - file_id * 10 - page) as num from s where disputed = any_disputed group by param, stage
    """,
)
def stage_score(spark, sf_dir):
    """Score of a candidate value; where any is disputed only disputed ones compete."""
    score = F.when(F.col("role") == "CURRENT", 10).otherwise(0) + F.when(F.col("source") == "S1", 2).otherwise(0) + F.col("num").isNotNull().cast("int")
    any_disputed = F.bool_or("disputed").over(W.partitionBy("param", "stage"))
    rows = mentions(spark, sf_dir).withColumn("score", score).withColumn("any_disputed", any_disputed).where("disputed = any_disputed")
    order = F.struct("score", -F.col("file_id"), -F.col("page"))
    return rows.groupBy("param", "stage").agg(F.max("score").alias("best"), F.max_by("num", order).alias("num"))


@query(
    "page_offsets",
    """
    with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when l_discount > 0.09 then null else cast(l_quantity as bigint) end as pages,
                 row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as seq from lineitem)
    select l_orderkey, seq, case when coalesce(sum(case when pages is null then 1 else 0 end) over w, 0) = 0 then coalesce(sum(pages) over w, 0) end as first_page
    from p window w as (partition by l_orderkey order by seq rows between unbounded preceding and 1 preceding)
    """,
    {"seq": "integer", "first_page": "bigint"},
)
def page_offsets(spark, sf_dir):
    """Cumulative page offsets of a document's parts, unknown after a part of unknown length."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    pages = F.when(F.col("l_discount") > 0.09, None).otherwise(F.col("l_quantity").cast("long"))
    rows = table(spark, sf_dir, "lineitem").withColumn("pages", pages).withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order)))
    return running_offset(rows, ["l_orderkey"], ["seq"], "pages", "first_page").select("l_orderkey", "seq", "first_page")


@query(
    "merge_runs",
    """
    with o as (select l_orderkey, l_returnflag as material, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as seq from lineitem),
    c as (select *, case when material <> lag(material) over (partition by l_orderkey order by seq) then 1 else 0 end as step from o),
    i as (select *, sum(step) over (partition by l_orderkey order by seq) as run from c)
    select l_orderkey, run, material, sum(l_quantity) as thickness, count(*) as n from i group by l_orderkey, run, material
    """,
    {"run": "bigint"},
)
def merge_runs(spark, sf_dir):
    """Consecutive layers of one material are one layer."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    seq = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*order))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("material"), "l_quantity", seq.alias("seq"))
    changed = F.col("material") != F.lag("material").over(W.partitionBy("l_orderkey").orderBy("seq"))
    runs = islands(rows, ["l_orderkey"], ["seq"], changed, "run")
    return runs.groupBy("l_orderkey", "run", "material").agg(F.sum("l_quantity").alias("thickness"), F.count("*").alias("n"))


@query(
    "common_variant",
    f"""
    with v as (select distinct param, stage, supplier % 20 as variant from {MENTIONS_SQL} m)
    select a.param, min(a.variant) as variant, count(distinct a.variant) as shared from v a join v b on a.param = b.param and a.variant = b.variant and a.stage = 'PD' and b.stage <> 'PD' group by a.param
    """,
    {"shared": "integer"},
)
def common_variant(spark, sf_dir):
    """The first variant that the design and a later stage share."""
    rows = mentions(spark, sf_dir).withColumn("variant", F.col("supplier") % 20)
    sets = rows.groupBy("param").agg(
        F.collect_set(F.when(F.col("stage") == "PD", F.col("variant"))).alias("design"),
        F.collect_set(F.when(F.col("stage") != "PD", F.col("variant"))).alias("later"),
    )
    shared = F.array_intersect("design", "later")
    return sets.where(F.size(shared) > 0).select("param", F.array_min(shared).alias("variant"), F.size(shared).alias("shared"))


@query(
    "weakest_section",
    f"select param, min(num) as num, arg_min(price, num * 1e9 + price) as price from {MENTIONS_SQL} m group by param",
)
def weakest_section(spark, sf_dir):
    """The lexicographically weakest profile."""
    weakest = F.min(F.struct("num", "price")).alias("w")
    return mentions(spark, sf_dir).groupBy("param").agg(weakest).select("param", "w.num", "w.price")
