"""Quality metrics, robust statistics, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.components import components
from factloom.operators.stats import auc, hash_share, nearest_rank, ratio, robust_model, wilson, zero_error_bound
from factloom.plans.registry import query
from factloom.sources.tables import table

CARDS_SQL = "(select doc_id, source, toxic, quality, (n_chars % 97) / 96.0 as p from documents join labels using (doc_id))"


def cards(spark, sf_dir):
    """Labelled candidate cards with a score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("p", (F.col("n_chars") % 97) / 96.0)


@query(
    "percentiles",
    """
    select event_type, quantile_disc(value, 0.95) as p95_rank, round(quantile_cont(value, 0.95), 9) as p95_linear, median(value) as med,
           max(value) as most from events group by event_type
    """,
)
def percentiles(spark, sf_dir):
    """Nearest-rank and interpolated percentiles, which are two functions."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        nearest_rank("value", 0.95).alias("p95_rank"),
        F.round(F.expr("percentile(value, 0.95)"), 9).alias("p95_linear"),
        F.median("value").alias("med"),
        F.max("value").alias("most"),
    )


@query(
    "anomalies",
    """
    with v as (select event_id, event_type, ln(value) as lv from events where value > 0),
    m as (select event_type, median(lv) as med, count(*) as n from v group by 1),
    d as (select v.event_type, any_value(med) as med, any_value(n) as n, 1.4826 * median(abs(lv - med)) as mad from v join m using (event_type) group by 1)
    select event_id, round(exp(lv - med) - 1, 6) as deviation, round((lv - med) / mad, 6) as z from v join d using (event_type)
    where n >= 5 and mad > 0 and abs(exp(lv - med) - 1) >= 0.2 and abs((lv - med) / mad) >= 3.5
    """,
)
def anomalies(spark, sf_dir):
    """Values far from their kind's median, in the logarithm, by both share and robust z."""
    events = table(spark, sf_dir, "events").where("value > 0").withColumn("lv", F.ln("value"))
    model = robust_model(events, ["event_type"], F.col("lv")).where("n >= 5 and mad > 0")
    off = F.col("lv") - F.col("median")
    scored = events.join(model, "event_type").select("event_id", (F.exp(off) - 1).alias("deviation"), (off / F.col("mad")).alias("z"))
    far = scored.where("abs(deviation) >= 0.2 and abs(z) >= 3.5")
    return far.select("event_id", F.round("deviation", 6).alias("deviation"), F.round("z", 6).alias("z"))


@query(
    "object_profile",
    """
    select o_custkey, round(median(o_totalprice), 6) as price, round(median(o_totalprice) / any_value(c_acctbal), 6) as per_area
    from orders join customer on o_custkey = c_custkey where c_acctbal > 0 group by o_custkey
    """,
)
def object_profile(spark, sf_dir):
    """Medians by object, one of them per unit of area."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    median = F.median("o_totalprice")
    return rows.groupBy("o_custkey").agg(F.round(median, 6).alias("price"), F.round(median / F.first("c_acctbal"), 6).alias("per_area"))


@query(
    "confusion",
    f"""
    with c as (select source, count(*) filter (where p >= 0.5 and toxic = 1) as tp, count(*) filter (where p >= 0.5 and toxic = 0) as fp,
                 count(*) filter (where p < 0.5 and toxic = 1) as fn, count(*) filter (where p < 0.5 and toxic = 0) as tn, avg((p - toxic) * (p - toxic)) as b from {CARDS_SQL} k group by 1)
    select source, tp, fp, fn, tn, round(case when tp + fp = 0 then 0.0 else tp / (tp + fp) end, 9) as precision_zero,
           round(case when tp + fn > 0 then tp / (tp + fn) end, 9) as recall_null, round(case when 2 * tp + fp + fn = 0 then 0.0 else 2.0 * tp / (2 * tp + fp + fn) end, 9) as f1,
           round(case when fp + tn = 0 then 0.0 else fp / (fp + tn) end, 9) as fpr, round(b, 9) as brier from c
    """,
)
def confusion(spark, sf_dir):
    """Confusion counts, ratios under both conventions for the undefined, and the Brier score."""
    hit, toxic = F.col("p") >= 0.5, F.col("toxic") == 1
    c = cards(spark, sf_dir).groupBy("source").agg(
        F.count_if(hit & toxic).alias("tp"), F.count_if(hit & ~toxic).alias("fp"), F.count_if(~hit & toxic).alias("fn"), F.count_if(~hit & ~toxic).alias("tn"),
        F.avg(F.pow(F.col("p") - F.col("toxic"), 2)).alias("b"),
    )
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return c.select(
        "source", "tp", "fp", "fn", "tn",
        F.round(ratio(tp, tp + fp, 0.0), 9).alias("precision_zero"),
        F.round(ratio(tp, tp + fn), 9).alias("recall_null"),
        F.round(ratio(2 * tp, 2 * tp + fp + fn, 0.0), 9).alias("f1"),
        F.round(ratio(fp, fp + tn, 0.0), 9).alias("fpr"),
        F.round("b", 9).alias("brier"),
    )


@query(
    "choose_threshold",
    f"""
    with s as (select p, count(*) filter (where toxic = 0) as pos, count(*) filter (where toxic = 1) as neg from {CARDS_SQL} k group by p),
    c as (select p, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over () as total, lead(p) over (order by p desc) as below from s window w as (order by p desc)),
    t as (select coalesce((p + below) / 2, p) as threshold, tp / total as recall, 2.0 * tp / (tp + fp + total) as f1 from c)
    select round(threshold, 9) as threshold, round(recall, 9) as recall, round(f1, 9) as f1 from t where recall >= 0.3 order by f1 desc, threshold limit 1
    """,
)
def choose_threshold(spark, sf_dir):
    """Midpoint threshold of the best F1 among those of enough recall; windows run over distinct scores."""
    scores = cards(spark, sf_dir).groupBy("p").agg(F.count_if(F.col("toxic") == 0).alias("pos"), F.count_if(F.col("toxic") == 1).alias("neg"))
    down = W.orderBy(F.desc("p"))  # at most as many rows as there are scores
    c = scores.select(
        "p", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(W.partitionBy()).alias("total"), F.lead("p").over(down).alias("below")
    )
    t = c.select(
        F.coalesce((F.col("p") + F.col("below")) / 2, F.col("p")).alias("threshold"),
        (F.col("tp") / F.col("total")).alias("recall"),
        (2.0 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("total"))).alias("f1"),
    )
    best = t.where("recall >= 0.3").orderBy(F.desc("f1"), "threshold").limit(1)
    return best.select(*[F.round(k, 9).alias(k) for k in best.columns])


@query(
    "roc_auc",
    f"""
    with r as (select source, toxic, rank() over (partition by source order by p) + (count(*) over (partition by source, p) - 1) / 2.0 as r from {CARDS_SQL} k),
    s as (select source, sum(r) filter (where toxic = 1) as s, count(*) filter (where toxic = 1) as p, count(*) filter (where toxic = 0) as n from r group by 1)
    select source, round(case when p * n > 0 then (s - p * (p + 1) / 2.0) / (p * n) end, 9) as auc from s
    """,
)
def roc_auc(spark, sf_dir):
    return auc(cards(spark, sf_dir), "p", "toxic", ["source"]).withColumn("auc", F.round("auc", 9))


@query(
    "wilson_intervals",
    f"""
    with c as (select source, sum(quality) as k, count(*) as n from {CARDS_SQL} t group by 1),
    w as (select *, k / n as p, 1.96 * 1.96 as z2 from c)
    select source, n, round(greatest(0.0, (p + z2 / (2 * n) - 1.96 * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)), 9) as low,
           round(least(1.0, (p + z2 / (2 * n) + 1.96 * sqrt((p * (1 - p) + z2 / (4 * n)) / n)) / (1 + z2 / n)), 9) as high,
           round(1 - pow(0.05, 1.0 / n), 9) as zero_error_bound from w
    """,
)
def wilson_intervals(spark, sf_dir):
    """Interval of a share by source and the bound that no error in so many trials gives."""
    c = cards(spark, sf_dir).groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    low, high = wilson(F.col("k"), F.col("n"))
    return c.select("source", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(zero_error_bound(F.col("n"), 0.95), 9).alias("zero_error_bound"))


@query(
    "hash_split",
    """
    with h as (select doc_id, source, ('0x' || substring(sha256('7:' || doc_id), 1, 8))::bigint / 4294967295.0 as u from documents)
    select source, case when u < 0.7 then 'train' when u < 0.85 then 'dev' else 'test' end as split, count(*) as n, min(doc_id) as first_doc from h group by 1, 2
    """,
)
def hash_split(spark, sf_dir):
    """Deterministic 70/15/15 split by digest."""
    u = hash_share(F.concat(F.lit("7:"), F.col("doc_id").cast("string")))
    split = F.when(u < 0.7, "train").when(u < 0.85, "dev").otherwise("test")
    rows = table(spark, sf_dir, "documents").withColumn("split", split)
    return rows.groupBy("source", "split").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "component_split",
    """
    with recursive e as (select distinct l_orderkey as a, 1000000 + l_partkey as b from lineitem where l_quantity = 50 and l_discount > 0.08),
    both_ways as (select a, b from e union select b, a from e), n as (select distinct a as node from both_ways),
    reach(node, other) as (select node, node from n union select reach.node, both_ways.b from reach join both_ways on both_ways.a = reach.other),
    r as (select node, min(other) as root from reach group by 1)
    select node, root, case when ('0x' || substring(sha256('7:' || root), 1, 8))::bigint / 4294967295.0 < 0.8 then 'train' else 'test' end as split from r where node < 1000000
    """,
)
def component_split(spark, sf_dir):
    """Tasks that share content, directly or by way of others, are on one side of a split."""
    e = table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_discount > 0.08").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b")).distinct()
    split = F.when(hash_share(F.concat(F.lit("7:"), F.col("root").cast("string"))) < 0.8, "train").otherwise("test")
    return components(e).where("node < 1000000").select("node", "root", split.alias("split"))


@query(
    "stratified_sample",
    """
    with s as (select doc_id, lang, source, row_number() over (partition by lang, source order by sha256('3:' || doc_id), doc_id) as round_no, sha256('3:' || doc_id) as h from documents)
    select doc_id, lang, source, round_no from s order by round_no, h, doc_id limit 60
    """,
    {"round_no": "integer"},
)
def stratified_sample(spark, sf_dir):
    """Round-robin over strata in a seeded order."""
    h = F.sha2(F.concat(F.lit("3:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", h.alias("h"))
    rounds = rows.withColumn("round_no", F.row_number().over(W.partitionBy("lang", "source").orderBy("h", "doc_id")))
    return rounds.orderBy("round_no", "h", "doc_id").limit(60).select("doc_id", "lang", "source", "round_no")


@query(
    "random_key_seek",
    """
    with k as (select doc_id, sha256(cast(doc_id as varchar)) as random_key from documents)
    select doc_id, random_key from (select *, case when random_key >= '80' then 0 else 1 end as wrapped from k) t order by wrapped, random_key limit 1
    """,
)
def random_key_seek(spark, sf_dir):
    """The first row at or after a random key, from the start again after the last."""
    key = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    rows = table(spark, sf_dir, "documents").select("doc_id", key.alias("random_key"))
    return rows.orderBy((F.col("random_key") < "80").cast("int"), "random_key").limit(1)


@query(
    "weighted_choice",
    """
    with w as (select source, count(*) as weight from documents group by 1), c as (select *, sum(weight) over (order by source) as upto, sum(weight) over () as total from w)
    select arg_min(source, upto) as chosen from c where upto > 0.37 * total
    """,
)
def weighted_choice(spark, sf_dir):
    """The stratum in which a share of the total weight falls."""
    w = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("weight"))
    c = w.select("source", F.sum("weight").over(W.orderBy("source")).alias("upto"), F.sum("weight").over(W.partitionBy()).alias("total"))
    return c.where(F.col("upto") > 0.37 * F.col("total")).agg(F.min_by("source", "upto").alias("chosen"))


@query(
    "publication_gate",
    """
    with a as (select l_suppkey % 10 as category, avg(case when l_returnflag = 'A' then 1.0 else 0.0 end) as prev from lineitem where l_suppkey % 10 < 8 and l_linenumber <= 3 group by 1),
    b as (select l_suppkey % 10 as category, avg(case when l_returnflag = 'A' then 1.0 else 0.0 end) as next from lineitem where l_suppkey % 10 > 1 and l_linenumber > 3 group by 1)
    select coalesce(a.category, b.category) as category, round(prev, 9) as prev, round(next, 9) as next,
           case when prev is null then 'NEW' when next is null then 'GONE' when prev - next > 0.005 + 1e-9 then 'REGRESSION' else 'FINE' end as verdict
    from a full outer join b on a.category = b.category
    """,
)
def publication_gate(spark, sf_dir):
    """Regressions between two releases by category."""
    category = (F.col("l_suppkey") % 10).alias("category")
    share = F.avg(F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0))
    lines = table(spark, sf_dir, "lineitem")
    a = lines.where("l_suppkey % 10 < 8 and l_linenumber <= 3").groupBy(category).agg(share.alias("prev"))
    b = lines.where("l_suppkey % 10 > 1 and l_linenumber > 3").groupBy(category).agg(share.alias("next"))
    verdict = F.when(F.col("prev").isNull(), "NEW").when(F.col("next").isNull(), "GONE").when(F.col("prev") - F.col("next") > 0.005 + 1e-9, "REGRESSION").otherwise("FINE")
    return a.join(b, "category", "full_outer").select("category", F.round("prev", 9).alias("prev"), F.round("next", 9).alias("next"), verdict.alias("verdict"))


@query(
    "dataset_leaks",
    """
    select l_partkey as sha, count(distinct l_orderkey % 3) as splits, count(*) as items, count(distinct l_orderkey % 3) > 1 as leak from lineitem where l_quantity = 50 group by 1
    """,
)
def dataset_leaks(spark, sf_dir):
    """Content that is in more than one split."""
    split = F.col("l_orderkey") % 3
    rows = table(spark, sf_dir, "lineitem").where("l_quantity = 50").groupBy(F.col("l_partkey").alias("sha"))
    return rows.agg(F.countDistinct(split).alias("splits"), F.count("*").alias("items"), (F.countDistinct(split) > 1).alias("leak"))


@query(
    "match_findings",
    """
    with g as (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag = 'R'), p as (select distinct l_orderkey, l_linenumber from lineitem where l_discount > 0.05)
    select coalesce(g.l_orderkey, p.l_orderkey) % 50 as object, count(*) filter (where g.l_orderkey is not null and p.l_orderkey is not null) as tp,
           count(*) filter (where g.l_orderkey is null) as fp, count(*) filter (where p.l_orderkey is null) as fn
    from g full outer join p on g.l_orderkey = p.l_orderkey and g.l_linenumber = p.l_linenumber group by 1
    """,
)
def match_findings(spark, sf_dir):
    """Gold and predicted findings matched by key, counted by object."""
    lines, keys = table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    g = lines.where("l_returnflag = 'R'").select(*keys).distinct().withColumn("g", F.lit(True))
    p = lines.where("l_discount > 0.05").select(*keys).distinct().withColumn("p", F.lit(True))
    both = g.join(p, keys, "full_outer")
    return both.groupBy((F.col("l_orderkey") % 50).alias("object")).agg(
        F.count_if(F.col("g") & F.col("p")).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )


@query(
    "metric_verdict",
    f"""
    with m as (select 'quality' as metric, avg(quality) as v from labels union all select 'toxic', avg(toxic) from labels union all select 'chars', avg(n_chars) from documents),
    t(metric, op, bound) as (values ('quality', '>=', 0.8), ('toxic', '<=', 0.05), ('chars', '>=', 100.0), ('absent', '>=', 1.0))
    select t.metric, case when v is null then 'NO_DATA' when (op = '>=' and v >= bound) or (op = '<=' and v <= bound) then 'PASS' else 'FAIL' end as verdict,
           bool_and(coalesce((op = '>=' and v >= bound) or (op = '<=' and v <= bound), false)) over () as accepted from t left join m on m.metric = t.metric
    """,
)
def metric_verdict(spark, sf_dir):
    """Named metrics against thresholds, and the verdict over all."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    one = lambda df, name, c: df.agg(F.avg(c).alias("v")).select(F.lit(name).alias("metric"), "v")
    metrics = one(labels, "quality", "quality").unionAll(one(labels, "toxic", "toxic")).unionAll(one(docs, "chars", "n_chars"))
    bounds = spark.createDataFrame([("quality", ">=", 0.8), ("toxic", "<=", 0.05), ("chars", ">=", 100.0), ("absent", ">=", 1.0)], "metric string, op string, bound double")
    passed = F.when(F.col("op") == ">=", F.col("v") >= F.col("bound")).otherwise(F.col("v") <= F.col("bound"))
    verdict = F.when(F.col("v").isNull(), "NO_DATA").when(passed, "PASS").otherwise("FAIL")
    accepted = F.bool_and(F.coalesce(passed, F.lit(False))).over(W.partitionBy())
    return bounds.join(metrics, "metric", "left").select("metric", verdict.alias("verdict"), accepted.alias("accepted"))


@query(
    "sample_pool",
    """
    select o_orderkey, case when o_totalprice < 20000 then 1 - pow(0.05, 1.0 / 59) end as bound from orders
    where o_orderstatus in ('F', 'O') and (nullif(o_orderpriority, '3-MEDIUM') is null or o_orderpriority <= '2-HIGH')
    """,
)
def sample_pool(spark, sf_dir):
    """Checks fit for acceptance sampling: an unknown priority passes."""
    priority = F.nullif("o_orderpriority", F.lit("3-MEDIUM"))
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O") & (priority.isNull() | (F.col("o_orderpriority") <= "2-HIGH")))
    return rows.select("o_orderkey", F.when(F.col("o_totalprice") < 20000, zero_error_bound(F.lit(59), 0.95)).alias("bound"))


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    """Percentile interval of a ratio over resampled objects.

    Objects are resampled with Poisson weights drawn from a hash of object and replicate: one pass over the objects'
    sums and no pairs of objects.
    """
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    objects = rows.groupBy("source").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    u = F.pmod(F.xxhash64("source", "b"), F.lit(1_000_003)) / 1_000_003.0
    weight = sum(((u >= c).cast("int") for c in (0.3679, 0.7358, 0.9197, 0.9810, 0.9963, 0.9994)), F.lit(0))
    drawn = objects.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(1000)))).withColumn("w", weight)
    shares = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("k")) / F.sum(F.col("w") * F.col("n"))).alias("share"))
    return shares.agg(F.expr("percentile(share, 0.025)").alias("low"), F.expr("percentile(share, 0.975)").alias("high"), F.count("*").alias("replicates"))
