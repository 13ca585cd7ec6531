"""Rules over facts: logical, semantic and normative hypotheses, their union and deduplication, cascades, lowering."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.compare import compare
from factloom.operators.picks import first_per
from factloom.operators.rules import ancestors, bounded_key, dedupe, effective
from factloom.plans.registry import query
from factloom.sources.tables import table

#: condition key, operator, value, expected key, operator, value
LOGICAL = [(1, "purchase", ">", 120.0, "error", "<", 100.0), (2, "view", ">=", 90.0, "click", ">=", 60.0), (3, "signup", "<", 200.0, "view", "!=", 0.0)]
_LOGICAL_SQL = ", ".join(f"({i}, '{a}', '{o}', {v}, '{b}', '{p}', {w})" for i, a, o, v, b, p, w in LOGICAL)
_CMP = "case {op} when '>' then {x} > {y} when '>=' then {x} >= {y} when '<' then {x} < {y} when '!=' then {x} <> {y} end"


@query(
    "logical_rules",
    f"""
    with f as (select user_id, event_type as k, max(value) as v from events group by 1, 2),
    r(rule_id, ck, cop, cv, ek, eop, ev) as (values {_LOGICAL_SQL})
    select rule_id, a.user_id, a.v as condition_value, b.v as actual from r join f a on a.k = ck join f b on b.user_id = a.user_id and b.k = ek
    where {_CMP.format(op="cop", x="a.v", y="cv")} and not ({_CMP.format(op="eop", x="b.v", y="ev")})
    """,
)
def logical_rules(spark, sf_dir):
    """If A holds then B must: two look-ups of facts onto rules."""
    facts = table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("k")).agg(F.max("value").alias("v"))
    rules = spark.createDataFrame(LOGICAL, "rule_id int, ck string, cop string, cv double, ek string, eop string, ev double")
    a, b = facts.toDF("user_id", "ck", "condition_value"), facts.toDF("user_id", "ek", "actual")
    met = F.broadcast(rules).join(a, "ck").join(b, ["user_id", "ek"])  # the rules are three constant rows
    hit = compare(F.col("condition_value"), F.col("cop"), F.col("cv")) & ~compare(F.col("actual"), F.col("eop"), F.col("ev"))
    return met.where(hit).select("rule_id", "user_id", "condition_value", "actual")


@query(
    "normative_rules",
    """
    with norms(k, low, high, since, until) as (values ('error', 5.0, 150.0, date '2024-01-01', null), ('view', null, 120.0, null, date '2024-01-20'), ('click', 2.0, null, date '2024-01-10', date '2024-01-25'))
    select event_id, k, value, case when value < low - 1e-9 then 'LOW' else 'HIGH' end as breach from events join norms on event_type = k
    where (since is null or since <= cast(ts as date)) and (until is null or cast(ts as date) <= until) and (value < low - 1e-9 or value > high + 1e-9)
    """,
)
def normative_rules(spark, sf_dir):
    """Facts outside the limits of the norm in force at their date."""
    rows = [("error", 5.0, 150.0, "2024-01-01", None), ("view", None, 120.0, None, "2024-01-20"), ("click", 2.0, None, "2024-01-10", "2024-01-25")]
    norms = spark.createDataFrame(rows, "k string, low double, high double, since string, until string")
    norms = norms.withColumns({"since": F.to_date("since"), "until": F.to_date("until")})
    events = table(spark, sf_dir, "events")
    met = events.join(F.broadcast(norms), F.col("event_type") == F.col("k"))  # three constant rows
    low, high = F.col("value") < F.col("low") - 1e-9, F.col("value") > F.col("high") + 1e-9
    met = met.where(effective(F.col("since"), F.col("until"), F.col("ts").cast("date")) & (low | high))
    return met.select("event_id", "k", "value", F.when(low, "LOW").otherwise("HIGH").alias("breach"))


@query(
    "norm_in_force",
    """
    with base as (select p_brand as norm, p_partkey as rec, p_size as since, p_size + 20 as until, p_retailprice as value from part),
    points as (select distinct p_brand as norm, d from part cross join (values (5), (25), (45), (75)) t(d))
    select points.norm, points.d, arg_max(value, since * 1000000 + rec) as value, count(rec) as n from points left join base on base.norm = points.norm and since <= d and d <= until
    group by points.norm, points.d
    """,
)
def norm_in_force(spark, sf_dir):
    """As-of: the record in force at a date, the last one winning; a norm without one stays without."""
    part = table(spark, sf_dir, "part")
    base = part.select(F.col("p_brand").alias("norm"), F.col("p_partkey").alias("rec"), F.col("p_size").alias("since"), (F.col("p_size") + 20).alias("until"), F.col("p_retailprice").alias("value"))
    at = part.select(F.col("p_brand").alias("norm")).distinct().withColumn("d", F.explode(F.array(*map(F.lit, (5, 25, 45, 75)))))
    same = (F.col("a.norm") == F.col("b.norm")) & effective(F.col("since"), F.col("until"), F.col("d"))
    met = at.alias("a").join(base.alias("b"), same, "left")
    return met.groupBy("a.norm", "d").agg(F.max_by("value", F.struct("since", "rec")).alias("value"), F.count("rec").alias("n"))


@query(
    "semantic_rooms",
    """
    with pd as (select l_orderkey, l_linenumber, p_name from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as rn
                  from lineitem join part on l_partkey = p_partkey where l_returnflag = 'A') t where rn = 1),
    rd as (select l_orderkey, l_linenumber, p_name from (select *, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey) as rn
                  from lineitem join part on l_partkey = p_partkey where l_returnflag = 'R') t where rn = 1)
    select pd.l_orderkey, pd.l_linenumber, pd.p_name as was, rd.p_name as now,
           len(list_intersect(string_split(pd.p_name, ' '), string_split(rd.p_name, ' '))) / 2.0 as similarity
    from pd join rd on pd.l_orderkey = rd.l_orderkey and pd.l_linenumber = rd.l_linenumber
    where len(list_intersect(string_split(pd.p_name, ' '), string_split(rd.p_name, ' '))) < 1
    """,
)
def semantic_rooms(spark, sf_dir):
    """Rooms of one number whose names share no word: the first mention in each stage wins."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    keys = ["l_orderkey", "l_linenumber"]
    side = lambda s, name: first_per(rows.where(F.col("l_returnflag") == s), keys, [F.asc("l_partkey"), F.asc("l_suppkey")]).select(*keys, F.col("p_name").alias(name))
    shared = F.size(F.array_intersect(F.split("was", " "), F.split("now", " ")))
    met = side("A", "was").join(side("R", "now"), keys).withColumn("similarity", shared / 2.0)
    return met.where(F.col("similarity") < 0.5)


@query(
    "hypotheses",
    """
    with h as (
      select 'LOGICAL' as method, 'u' || user_id as dedup_key, 0.6 as confidence, event_id as ordinal from events where event_type = 'error' and value > 100
      union all select 'NORMATIVE', 'u' || user_id, 0.9, event_id from events where event_type = 'view' and value > 90
      union all select 'SEMANTIC', 'u' || user_id || repeat('x', 600), 0.5, event_id from events where event_type = 'click' and value > 130)
    select method, case when strlen(dedup_key) <= 512 then dedup_key else left(dedup_key, 111) || ':' || sha256(dedup_key) end as dedup_key, confidence, ordinal
    from (select *, row_number() over (partition by dedup_key order by confidence desc, ordinal) as rn from h) t where rn = 1
    """,
    {"confidence": "double"},
)
def hypotheses(spark, sf_dir):
    """Hypotheses of all methods together, one for each bounded key."""
    events = table(spark, sf_dir, "events")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))

    def raised(method, kind, least, confidence, key):
        rows = events.where((F.col("event_type") == kind) & (F.col("value") > least))
        return rows.select(F.lit(method).alias("method"), key.alias("dedup_key"), F.lit(confidence).alias("confidence"), F.col("event_id").alias("ordinal"))

    raised_all = raised("LOGICAL", "error", 100, 0.6, user).unionByName(raised("NORMATIVE", "view", 90, 0.9, user))
    raised_all = raised_all.unionByName(raised("SEMANTIC", "click", 130, 0.5, F.concat(user, F.repeat(F.lit("x"), 600))))
    return dedupe(raised_all.withColumn("dedup_key", bounded_key(F.col("dedup_key"))))


@query(
    "order_inversions",
    """
    with s as (select l_orderkey, l_linenumber as i, min(l_shipdate) filter (where l_returnflag = 'A') as a, min(l_shipdate) filter (where l_returnflag = 'R') as b from lineitem group by 1, 2),
    p as (select * from s where a is not null and b is not null)
    select x.l_orderkey, x.i as first_row, y.i as second_row from p x join p y on x.l_orderkey = y.l_orderkey and x.i < y.i and ((x.a < y.a and x.b > y.b) or (x.a > y.a and x.b < y.b))
    """,
)
def order_inversions(spark, sf_dir):
    """Pairs of works whose order differs between two schedules."""
    starts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("i")).agg(
        F.min(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).alias("a"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("b")
    )
    p = starts.where("a is not null and b is not null")
    turned = "x.l_orderkey = y.l_orderkey and x.i < y.i and ((x.a < y.a and x.b > y.b) or (x.a > y.a and x.b < y.b))"
    return p.alias("x").join(p.alias("y"), F.expr(turned)).select("x.l_orderkey", F.col("x.i").alias("first_row"), F.col("y.i").alias("second_row"))


@query(
    "act_before_work",
    """
    select a.l_orderkey, count(*) as n from lineitem a join lineitem w on a.l_orderkey = w.l_orderkey and a.l_returnflag = 'R' and w.l_returnflag = 'A'
      and strftime(a.l_shipdate, '%m-%d') < strftime(w.l_shipdate, '%m-%d') group by a.l_orderkey
    """,
)
def act_before_work(spark, sf_dir):
    """Acts dated before the work they accept, on dates whose year is unknown."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", F.date_format("l_shipdate", "MM-dd").alias("day"))
    acts, works = lines.where("l_returnflag = 'R'").alias("a"), lines.where("l_returnflag = 'A'").alias("w")
    met = acts.join(works, (F.col("a.l_orderkey") == F.col("w.l_orderkey")) & (F.col("a.day") < F.col("w.day")))
    return met.groupBy("a.l_orderkey").agg(F.count("*").alias("n"))


@query(
    "common_root_siblings",
    """
    with s as (select distinct l_partkey as param, l_orderkey as doc from lineitem where l_quantity > 48)
    select param, sibling from (select a.param, b.param as sibling, row_number() over (partition by a.param order by b.param) as rn
      from (select distinct a.param, b.param as p2 from s a join s b on a.doc = b.doc and a.param <> b.param) x(param, p2)
      join lateral (select x.param as param) a on true join lateral (select x.p2 as param) b on true) t where rn <= 20
    """,
)
def common_root_siblings(spark, sf_dir):
    """Parameters found in the same documents, at most twenty for each."""
    s = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("param"), F.col("l_orderkey").alias("doc")).distinct()
    pairs = s.alias("a").join(s.alias("b"), (F.col("a.doc") == F.col("b.doc")) & (F.col("a.param") != F.col("b.param")))
    pairs = pairs.select(F.col("a.param").alias("param"), F.col("b.param").alias("sibling")).distinct()
    return first_per(pairs, ["param"], [F.asc("sibling")], 20)


@query(
    "cascade_roots",
    """
    with recursive e as (select n_nationkey as child, (n_nationkey * 7 + 3) % 25 // 2 as parent from nation where n_nationkey > 3),
    up(node, ancestor) as (select child, parent from e union select node, parent from up join e on child = ancestor),
    c as (select distinct node, ancestor from up where ancestor % 3 <> 1)
    select node, min(ancestor) as root, count(*) as n_ancestors from c group by node
    """,
)
def cascade_roots(spark, sf_dir):
    """Candidate ancestors of each check along dependencies, cycles broken by the smallest code."""
    nation = table(spark, sf_dir, "nation").where("n_nationkey > 3")
    edges = nation.select(F.col("n_nationkey").alias("child"), F.floor((F.col("n_nationkey") * 7 + 3) % 25 / 2).cast("int").alias("parent"))
    found = ancestors(edges).where("ancestor % 3 <> 1")
    return found.groupBy("node").agg(F.min("ancestor").alias("root"), F.count("*").alias("n_ancestors"))


@query(
    "lowering",
    """
    with c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when l_returnflag = 'R' then 'CANDIDATE' else 'NEGATIVE_VERIFIED' end as s0,
                 l_linestatus = 'F' as stale, l_discount > 0.08 as poor_page, l_tax > 0.06 as refined from lineitem)
    select s0, case when s0 = 'CANDIDATE' and poor_page then 'CLARIFICATION_REQUIRED' when s0 = 'CANDIDATE' and stale then 'NOT_COMPARABLE'
                    when s0 = 'CANDIDATE' and refined then 'NEGATIVE_VERIFIED' else s0 end as status,
           case when s0 = 'CANDIDATE' then concat_ws(',', case when poor_page then 'GTE-04' end, case when stale and not poor_page then 'VER-03' end,
                case when refined and not stale and not poor_page then 'VER-07' end) else '' end as trace, count(*) as n
    from c group by all
    """,
)
def lowering(spark, sf_dir):
    """Checks that may only lower a finding, folded in order, with the trace of those that did."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "CANDIDATE").otherwise("NEGATIVE_VERIFIED").alias("s0"),
        (F.col("l_linestatus") == "F").alias("stale"),
        (F.col("l_discount") > 0.08).alias("poor_page"),
        (F.col("l_tax") > 0.06).alias("refined"),
    )
    status, trace = F.col("s0"), F.array().cast("array<string>")
    for code, flag, lower in (("GTE-04", "poor_page", "CLARIFICATION_REQUIRED"), ("VER-03", "stale", "NOT_COMPARABLE"), ("VER-07", "refined", "NEGATIVE_VERIFIED")):
        fires = (status == "CANDIDATE") & F.col(flag)
        trace = F.when(fires, F.concat(trace, F.array(F.lit(code)))).otherwise(trace)
        status = F.when(fires, lower).otherwise(status)
    lowered = rows.select("s0", status.alias("status"), F.array_join(trace, ",").alias("trace"))
    return lowered.groupBy("s0", "status", "trace").agg(F.count("*").alias("n"))


@query(
    "revision_selection",
    """
    with d as (select o_custkey, o_orderstatus, o_orderkey, o_orderdate, dense_rank() over (partition by o_custkey, o_orderstatus order by o_orderdate desc) as k from orders),
    f as (select *, count(*) filter (where k = 1) over (partition by o_custkey, o_orderstatus) as tops from d)
    select o_orderkey, case when k > 1 then 'SUPERSEDED' when tops > 1 then 'CONFLICT' else 'CURRENT' end as role from f
    """,
)
def revision_selection(spark, sf_dir):
    """Which of a document's revisions counts: the latest, unless two claim to be."""
    by = W.partitionBy("o_custkey", "o_orderstatus")
    rows = table(spark, sf_dir, "orders").withColumn("k", F.dense_rank().over(by.orderBy(F.desc("o_orderdate"))))
    rows = rows.withColumn("tops", F.count_if(F.col("k") == 1).over(by))
    role = F.when(F.col("k") > 1, "SUPERSEDED").when(F.col("tops") > 1, "CONFLICT").otherwise("CURRENT")
    return rows.select("o_orderkey", role.alias("role"))


@query(
    "carry_decisions",
    """
    with p as (select l_orderkey, sha256(string_agg(cast(l_partkey as varchar), ',' order by l_partkey)) as print, count(*) filter (where l_returnflag = 'R') as reds from lineitem where l_quantity > 45 group by 1)
    select p.print, min(l_orderkey) as old_check, max(l_orderkey) as new_check, count(*) as n from p group by p.print having count(*) > 1
    """,
)
def carry_decisions(spark, sf_dir):
    """Decisions carry over to checks of the same evidence fingerprint."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("l_partkey")), lambda x: x.cast("string")), ",")
    prints = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy("l_orderkey").agg(F.sha2(listed.cast("binary"), 256).alias("print"))
    same = prints.groupBy("print").agg(F.min("l_orderkey").alias("old_check"), F.max("l_orderkey").alias("new_check"), F.count("*").alias("n"))
    return same.where("n > 1")
