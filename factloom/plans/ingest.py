"""Registries, load plans and idempotent sinks over rows that stand for files."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.sources.files import assembled, batches, distinct_content, page_ranges, registry
from factloom.sources.sinks import insert_new, inserted_counts, upsert
from factloom.sources.tables import table

FILES_SQL = """
(select case l_returnflag when 'A' then 'pd' when 'N' then 'rd' else 'x' end || '/doc-' || l_partkey % 50 || case when l_linenumber > 3 then '_rev' || l_linenumber else '' end || '.pdf' as path,
        sha256(cast(l_partkey as varchar)) as sha, l_orderkey as object, cast(l_quantity as bigint) as bytes from lineitem)
"""


def _files(spark, sf_dir):
    stage = F.when(F.col("l_returnflag") == "A", "pd").when(F.col("l_returnflag") == "N", "rd").otherwise("x")
    revision = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("_rev"), F.col("l_linenumber").cast("string"))).otherwise("")
    path = F.concat(stage, F.lit("/doc-"), (F.col("l_partkey") % 50).cast("string"), revision, F.lit(".pdf"))
    return table(spark, sf_dir, "lineitem").select(
        path.alias("path"), F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("sha"), F.col("l_orderkey").alias("object"), F.col("l_quantity").cast("long").alias("bytes")
    )


@query(
    "path_registry",
    rf"""
    select path, case when path like 'pd/%' then 'PD' when path like 'rd/%' then 'RD' end as stage, upper(regexp_replace(regexp_extract(path, '([^/]+)\.pdf$', 1), '_rev[0-9]+$', '')) as code,
           try_cast(nullif(regexp_extract(path, '_rev([0-9]+)\.pdf$', 1), '') as integer) as revision, count(*) as n from {FILES_SQL} f group by 1
    """,
)
def path_registry(spark, sf_dir):
    """What paths say about documents."""
    return registry(_files(spark, sf_dir)).groupBy("path", "stage", "code", "revision").agg(F.count("*").alias("n"))


@query("content_dedup", f"select sha, min(path) as path from {FILES_SQL} f group by sha")
def content_dedup(spark, sf_dir):
    """One file for each content, the first path."""
    return distinct_content(_files(spark, sf_dir).select("sha", "path")).select("sha", "path")


@query(
    "batch_plan",
    f"""
    with recursive f as (select object, path, bytes, row_number() over (partition by object order by path, bytes) as i from {FILES_SQL} t),
    b as (select object, i, bytes as filled, 1 as files, 0 as batch from f where i = 1
          union all select f.object, f.i, case when filled + bytes > 60 or files >= 3 then bytes else filled + bytes end, case when filled + bytes > 60 or files >= 3 then 1 else files + 1 end,
                           case when filled + bytes > 60 or files >= 3 then batch + 1 else batch end from b join f on f.object = b.object and f.i = b.i + 1)
    select object, batch, count(*) as files, max(filled) as bytes from b group by 1, 2
    """,
)
def batch_plan(spark, sf_dir):
    """Greedy batches by bytes and number of files."""
    placed = batches(_files(spark, sf_dir), ["object"], 60, 3)
    return placed.groupBy("object", "batch").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query(
    "page_parts",
    """
    select o_orderkey as doc, first, least(first + 19, pages) as last from (select o_orderkey, cast(floor(o_totalprice / 5000) as integer) as pages, unnest(range(1, cast(floor(o_totalprice / 5000) as integer) + 1, 20)) as first from orders) t
    """,
    {"first": "integer", "last": "integer"},
)
def page_parts(spark, sf_dir):
    """Page ranges of documents, a row each, so that long documents spread over tasks."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.floor(F.col("o_totalprice") / 5000).cast("int").alias("pages"))
    return rows.select("doc", F.inline(page_ranges(F.col("pages"), 20)))


@query(
    "assembled_parts",
    """
    with p as (select l_orderkey as doc, l_linenumber as first, l_linenumber as last, min(l_returnflag) as text from lineitem group by 1, 2, 3),
    o as (select *, lag(last) over (partition by doc order by first) as before from p)
    select doc, bool_and(case when before is null then first = 1 else first = before + 1 end) as complete, string_agg(text, '' order by first) as text, max(last) as pages from o group by doc
    """,
)
def assembled_parts(spark, sf_dir):
    """Documents put together from parts, complete only without a gap."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("first")).agg(F.min("l_returnflag").alias("text"))
    return assembled(parts.withColumn("last", F.col("first")))


@query(
    "upsert_rows",
    """
    with t as (select c_custkey as k, c_acctbal as v, 0 as stamp from customer), n as (select o_custkey as k, o_totalprice as v, o_orderkey as stamp from orders)
    select k, v from (select *, row_number() over (partition by k order by new desc, stamp desc) as rn from (select *, 0 as new from t union all select *, 1 from n) u) x where rn = 1
    """,
)
def upsert_rows(spark, sf_dir):
    """New rows in place of old ones of the same key."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(0).cast("long").alias("at"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("at"))
    return upsert(old, new, ["k"], "at").select("k", "v")


@query(
    "insert_ignore",
    "select distinct o_custkey as k from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 3000)",
)
def insert_ignore(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("k"))
    return insert_new(known, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query(
    "counted_insert",
    """
    select s, count(*) as inserted from (select o_custkey as k, min(o_orderstatus) as s from orders group by 1) t
    where k not in (select c_custkey from customer where c_acctbal > 3000) group by 1
    """,
)
def counted_insert(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 3000").select(F.col("c_custkey").alias("k"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderstatus").alias("s"))
    return inserted_counts(known, rows, ["k"], ["s"])
