"""Totals and compositions: declared sums, changed roots, shares."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.compare import round_half_up
from factloom.operators.picks import first_per
from factloom.plans.registry import query
from factloom.sources.tables import dealt, table


@query(
    "sum_check",
    """
    select o_orderkey, round(o_totalprice, 2) as declared, round(sum(l_extendedprice), 2) as summed,
           abs(o_totalprice - sum(l_extendedprice)) > 100000 + 1e-9 as mismatch, count(*) as n_rows
    from orders join lineitem on o_orderkey = l_orderkey group by o_orderkey, o_totalprice
    """,
)
def sum_check(spark, sf_dir):
    """A declared total against the sum of its rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n_rows"))
    return table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey",
        F.round("o_totalprice", 2).alias("declared"),
        F.round("s", 2).alias("summed"),
        (F.abs(F.col("o_totalprice") - F.col("s")) > 100000 + 1e-9).alias("mismatch"),
        "n_rows",
    )


@query(
    "totals_compare",
    """
    with k as (select l_orderkey % 500 as doc, l_returnflag as stage, lower(p_type) as key, sum(l_quantity) as num
               from lineitem join part on l_partkey = p_partkey group by 1, 2, 3),
    a as (select * from k where stage = 'A'), b as (select * from k where stage = 'R')
    select coalesce(a.doc, b.doc) as doc, coalesce(a.key, b.key) as key, a.num as was, b.num as now,
           case when a.num is null then 'ADDED' when b.num is null then 'REMOVED' when abs(a.num - b.num) > 5 + 1e-9 then 'CHANGED' else 'SAME' end as root
    from a full outer join b on a.doc = b.doc and a.key = b.key
    """,
)
def totals_compare(spark, sf_dir):
    """Rows of two totals by folded key: what changed, came or went."""
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    by = [(F.col("l_orderkey") % 500).alias("doc"), "l_returnflag", F.lower("p_type").alias("key")]
    keyed = rows.groupBy(*by).agg(F.sum("l_quantity").alias("num"))
    side = lambda s, name: keyed.where(F.col("l_returnflag") == s).select("doc", "key", F.col("num").alias(name))
    both = side("A", "was").join(side("R", "now"), ["doc", "key"], "full_outer")
    change = F.abs(F.col("was") - F.col("now")) > 5 + 1e-9
    root = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(change, "CHANGED").otherwise("SAME")
    return both.withColumn("root", root)


@query(
    "composition_shares",
    """
    with s as (select l_suppkey, l_returnflag as stage, p_type, sum(l_quantity) as q from lineitem join part on l_partkey = p_partkey group by 1, 2, 3),
    r as (select *, 100 * q / sum(q) over (partition by l_suppkey, stage) as share from s),
    a as (select * from r where stage = 'A'), b as (select * from r where stage = 'N')
    select coalesce(a.l_suppkey, b.l_suppkey) as supplier, coalesce(a.p_type, b.p_type) as type, round(a.share, 6) as was, round(b.share, 6) as now,
           case when a.share is null then 'ADDED' when b.share is null then 'REMOVED' when abs(a.share - b.share) > 4 + 1e-9 then 'SHIFTED' else 'KEPT' end as change
    from a full outer join b on a.l_suppkey = b.l_suppkey and a.p_type = b.p_type
    """,
)
def composition_shares(spark, sf_dir):
    """Shares of a composition in two stages: types added or removed, shares shifted beyond percentage points."""
    part = table(spark, sf_dir, "part")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    sums = rows.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("stage"), F.col("p_type").alias("type")).agg(F.sum("l_quantity").alias("q"))
    shares = sums.withColumn("share", 100 * F.col("q") / F.sum("q").over(W.partitionBy("supplier", "stage")))
    side = lambda s, name: shares.where(F.col("stage") == s).select("supplier", "type", F.col("share").alias(name))
    both = side("A", "was").join(side("N", "now"), ["supplier", "type"], "full_outer")
    shift = F.abs(F.col("was") - F.col("now")) > 4 + 1e-9
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(shift, "SHIFTED").otherwise("KEPT")
    return both.select("supplier", "type", F.round("was", 6).alias("was"), F.round("now", 6).alias("now"), change.alias("change"))


@query(
    "stage_composition",
    """
    with f as (select l_partkey, l_returnflag as stage, l_orderkey, count(*) as n from lineitem group by 1, 2, 3),
    best as (select * from (select *, row_number() over (partition by l_partkey, stage order by n desc, l_orderkey) as rn from f) t where rn = 1),
    firsts as (select * from (select l.*, row_number() over (partition by l.l_partkey, l.l_returnflag, l_suppkey order by l_linenumber, l_quantity) as k
               from lineitem l join best b on l.l_partkey = b.l_partkey and l.l_returnflag = b.stage and l.l_orderkey = b.l_orderkey) t where k = 1)
    select l_partkey, l_returnflag as stage, sum(l_quantity) as total, count(*) as subtypes from firsts group by 1, 2
    """,
)
def stage_composition(spark, sf_dir):
    """The fullest file of a stage, the first mention of each sub-type there, summed."""
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_partkey", "l_returnflag"]
    files = lines.groupBy(*keys, "l_orderkey").agg(F.count("*").alias("n"))
    best = first_per(files, keys, [F.desc("n"), F.asc("l_orderkey")]).drop("n")
    firsts = first_per(lines.join(best, [*keys, "l_orderkey"]), [*keys, "l_suppkey"], [F.asc("l_linenumber"), F.asc("l_quantity")])
    return firsts.groupBy("l_partkey", F.col("l_returnflag").alias("stage")).agg(F.sum("l_quantity").alias("total"), F.count("*").alias("subtypes"))


@query(
    "section_totals",
    """
    with o as (select l_suppkey, l_quantity, l_linenumber = 1 as header, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity) as seq from lineitem),
    s as (select *, sum(case when header then 1 else 0 end) over (partition by l_suppkey order by seq) as section from o)
    select l_suppkey, section, count(*) as n_rows, sum(l_quantity) as subtotal, sum(sum(l_quantity)) over (partition by l_suppkey) as grand from s group by 1, 2
    """,
    {"section": "bigint"},
)
def section_totals(spark, sf_dir):
    """Sub-totals of the sections of a table and its grand total."""
    seq = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").withColumn("seq", seq)
    section = F.sum((F.col("l_linenumber") == 1).cast("int")).over(W.partitionBy("l_suppkey").orderBy("seq"))
    grouped = rows.withColumn("section", section).groupBy("l_suppkey", "section").agg(F.count("*").alias("n_rows"), F.sum("l_quantity").alias("subtotal"))
    return grouped.withColumn("grand", F.sum("subtotal").over(W.partitionBy("l_suppkey")))


@query(
    "quantity_conflict",
    """
    select l_orderkey, count(distinct l_quantity) > 1 as double_count, max(l_quantity) - min(l_quantity) > greatest(2.0, min(l_quantity) * 0.5) + 1e-9 as conflict,
           string_agg(cast(cast(l_quantity as bigint) as varchar) || ' (p. ' || cast(l_linenumber as varchar) || ')', '; ' order by l_linenumber, l_quantity) as value_list
    from lineitem group by l_orderkey
    """,
)
def quantity_conflict(spark, sf_dir):
    """Values of one document that disagree, and the list of them with pages."""
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("long").alias("q"))))
    text = F.transform(listed, lambda x: F.concat(x.q.cast("string"), F.lit(" (p. "), x.l_linenumber.cast("string"), F.lit(")")))
    low, high = F.min("l_quantity"), F.max("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.countDistinct("l_quantity") > 1).alias("double_count"),
        (high - low > F.greatest(F.lit(2.0), low * 0.5) + 1e-9).alias("conflict"),
        F.array_join(text, "; ").alias("value_list"),
    )


@query(
    "document_counts",
    """
    with parts as (select o_custkey as object, l_orderkey as document, l_linenumber as part, l_returnflag = 'N' as incomplete from orders join lineitem on o_orderkey = l_orderkey),
    docs as (select object, document, count(distinct part) as parts, bool_or(incomplete) as incomplete from parts group by 1, 2),
    loads as (select object, count(*) as documents, sum(parts) as parts, count(*) filter (where not incomplete) as complete from docs group by 1)
    select *, case when complete = 0 then 'EMPTY' when complete < documents then 'PARTIAL' else 'FULL' end as load,
           floor(100.0 * complete / documents + 0.5) as percent from loads
    """,
    {"parts": "bigint"},
)
def document_counts(spark, sf_dir):
    """Parts roll up to documents and documents to objects, with the load code and its rounded share."""
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "N").alias("incomplete")), "l_orderkey")
    parts = lines.groupBy("l_orderkey", "l_linenumber").agg(F.bool_or("incomplete").alias("incomplete"))
    parts = parts.groupBy("l_orderkey").agg(F.count("l_linenumber").alias("parts"), F.bool_or("incomplete").alias("incomplete"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("object"))
    docs = orders.distinct().join(parts, "l_orderkey")
    loads = docs.groupBy("object").agg(F.count("*").alias("documents"), F.sum("parts").alias("parts"), F.count_if(~F.col("incomplete")).alias("complete"))
    load = F.when(F.col("complete") == 0, "EMPTY").when(F.col("complete") < F.col("documents"), "PARTIAL").otherwise("FULL")
    return loads.withColumn("load", load).withColumn("percent", round_half_up(F.lit(100.0) * F.col("complete") / F.col("documents")))
