"""Matching of elements, names, stacks and vectors between stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators.match import align_stacks, greedy_pairs, keyed_diff, mutual_best, nearest_by_cosine
from factloom.plans.registry import query
from factloom.sources.tables import table


@query(
    "keyed_diff",
    """
    with a as (select o_custkey, o_orderpriority, sum(o_totalprice) as v from orders where o_orderstatus = 'F' group by 1, 2),
    b as (select o_custkey, o_orderpriority, sum(o_totalprice) as v from orders where o_orderstatus = 'O' group by 1, 2)
    select coalesce(a.o_custkey, b.o_custkey) as o_custkey, coalesce(a.o_orderpriority, b.o_orderpriority) as o_orderpriority, round(a.v, 2) as was, round(b.v, 2) as now,
      case when a.v is null then 'ADDED' when b.v is null then 'REMOVED' when abs(a.v - b.v) <= 50000 then 'SAME' else 'CHANGED' end as change
    from a full outer join b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority
    """,
)
def keyed_diff_query(spark, sf_dir):
    keys = ["o_custkey", "o_orderpriority"]
    side = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).groupBy(*keys).agg(F.sum("o_totalprice").alias("v"))
    found = keyed_diff(side("F"), side("O"), keys, "v", F.abs(F.col("was") - F.col("now")) <= 50000)
    return found.select(*keys, F.round("was", 2).alias("was"), F.round("now", 2).alias("now"), "change")


PAIRS_SQL = """
(select a.l_orderkey as k, a.l_linenumber as l, b.l_linenumber as r, abs(a.q - b.q) as d from
   (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem where l_returnflag = 'A' group by 1, 2) a join
   (select l_orderkey, l_linenumber, max(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1, 2) b on a.l_orderkey = b.l_orderkey and abs(a.q - b.q) <= 10)
"""


def _pairs(spark, sf_dir):
    side = lambda s, n: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == s).groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias(n)).agg(F.max("l_quantity").alias(f"q{n}"))
    return side("A", "l").join(side("R", "r"), "k").where("abs(ql - qr) <= 10").select("k", "l", "r", F.abs(F.col("ql") - F.col("qr")).alias("d"))


@query(
    "mutual_best",
    f"""
    with p as (select *, 10 - d as s from {PAIRS_SQL} x where 10 - d >= 6),
    m as (select *, max(s) over (partition by k, l) as bl, max(s) over (partition by k, r) as br from p),
    n as (select *, count(*) filter (where s = bl) over (partition by k, l) as nl, count(*) filter (where s = br) over (partition by k, r) as nr from m)
    select k, l, r, s, case when nl = 1 and nr = 1 then 'UNIQUE' else 'AMBIGUOUS' end as status from n where s = bl and s = br
    """,
)
def mutual_best_query(spark, sf_dir):
    """Elements of two stages that are each other's best match, and whether it is the only one."""
    pairs = _pairs(spark, sf_dir).withColumn("s", 10 - F.col("d")).drop("d")
    return mutual_best(pairs, ["k"], "l", "r", "s", 6.0)


@query("greedy_match")
def greedy_match(spark, sf_dir):
    """Elements matched closest first, each at most once."""
    return greedy_pairs(_pairs(spark, sf_dir), ["k"], "l", "r", "d")


@query(
    "jaccard_stacks",
    """
    with s as (select l_orderkey as k, l_returnflag as stage, list_sort(list_distinct(list(l_suppkey % 12))) as ms from lineitem group by 1, 2)
    select a.k, round(len(list_intersect(a.ms, b.ms)) / len(list_distinct(list_concat(a.ms, b.ms))), 9) as similarity from s a join s b on a.k = b.k and a.stage = 'A' and b.stage = 'R'
    where len(list_intersect(a.ms, b.ms)) / len(list_distinct(list_concat(a.ms, b.ms))) >= 0.5
    """,
)
def jaccard_stacks(spark, sf_dir):
    """Stacks of two stages alike by their materials."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("stage")).agg(F.collect_set(F.col("l_suppkey") % 12).alias("ms"))
    a, b = (s.where(F.col("stage") == x).select("k", F.col("ms").alias(n)) for x, n in (("A", "x"), ("R", "y")))
    similarity = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return a.join(b, "k").select("k", F.round(similarity, 9).alias("similarity")).where("similarity >= 0.5")


@query("layer_alignment")
def layer_alignment(spark, sf_dir):
    """Stacks of layers of two stages aligned, operation by operation."""
    layer = F.concat(F.substring("p_type", 1, 1), (F.col("l_suppkey") % 5).cast("string"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", layer.alias("m")))), lambda x: x.m)
    s = rows.groupBy(F.col("l_orderkey").alias("k"), "l_returnflag").agg(ordered.alias("ms"))
    a, b = (s.where(F.col("l_returnflag") == x).select("k", F.col("ms").alias(n)) for x, n in (("A", "was"), ("R", "now")))
    return align_stacks(a.join(b, "k"), "k", "was", "now")


@query(
    "cosine_neighbours",
    """
    with s as (select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score
      from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0)
    select query_id, vec_id, score from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
    """,
)
def cosine_neighbours(spark, sf_dir):
    """The five closest of all vectors to every one whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return nearest_by_cosine(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)


@query(
    "room_iou",
    """
    with b as (select l_orderkey as k, l_linenumber as i, l_returnflag as stage, min(l_quantity) as x0, min(l_discount) as y0, min(l_quantity) + 10 as x1, min(l_discount) + 0.05 as y1 from lineitem group by 1, 2, 3),
    p as (select a.k, a.i, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) as inter from b a join b b on a.k = b.k and a.i = b.i and a.stage = 'A' and b.stage = 'R')
    select k, i, round(inter / (1.0 - inter), 6) as iou from p where inter / (1.0 - inter) >= 0.3
    """,
)
def room_iou(spark, sf_dir):
    """Boxes of two stages that overlap enough to be the same place."""
    boxes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), "l_returnflag").agg(F.min("l_quantity").alias("x"), F.min("l_discount").alias("y"))
    side = lambda s, n: boxes.where(F.col("l_returnflag") == s).select("k", "i", F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    span = lambda c, w: F.greatest(F.lit(0.0), F.least(F.col(f"{c}a") + w, F.col(f"{c}b") + w) - F.greatest(f"{c}a", f"{c}b"))
    inter = span("x", 10) * span("y", 0.05)
    iou = side("A", "a").join(side("R", "b"), ["k", "i"]).select("k", "i", (inter / (1.0 - inter)).alias("iou"))
    return iou.where("iou >= 0.3").withColumn("iou", F.round("iou", 6))
