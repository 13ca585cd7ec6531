"""Document reading and evaluation: rows of words, code repair, relations, localisation, registries and scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import deletions
from factloom.operators.picks import first_per, islands
from factloom.operators.stats import ratio
from factloom.plans.registry import query
from factloom.sources.tables import table


@query(
    "group_rows",
    """
    with w as (select l_orderkey as page, l_extendedprice / 1000 as y, l_partkey as x, l_returnflag as word from lineitem),
    g as (select *, case when y - lag(y) over (partition by page order by y, x, word) > 4 then 1 else 0 end as step from w),
    r as (select *, sum(step) over (partition by page order by y, x, word) as row_no from g)
    select page, row_no, string_agg(word, ' ' order by x, y, word) as line, count(*) as words from r group by 1, 2
    """,
    {"row_no": "bigint"},
)
def group_rows(spark, sf_dir):
    """Words of a page grouped into lines by the gaps between their heights."""
    w = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_partkey").alias("x"), F.col("l_returnflag").alias("word"))
    order = ["y", "x", "word"]
    gap = F.col("y") - F.lag("y").over(W.partitionBy("page").orderBy(*order)) > 4
    rows = islands(w, ["page"], order, gap, "row_no")
    line = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "word"))), lambda a: a.word)
    return rows.groupBy("page", "row_no").agg(F.array_join(line, " ").alias("line"), F.count("*").alias("words"))


@query(
    "code_repair",
    """
    with r as (select distinct p_name as code from part), b as (select distinct replace(p_name, 'e', 'c') as read from part),
    d as (select read, code, levenshtein(read, code) as dist from b join r on levenshtein(read, code) <= 2),
    m as (select *, min(dist) over (partition by read) as best from d), k as (select read, min(code) as code, min(dist) as dist, count(*) as n from m where dist = best group by 1)
    select p_partkey, case when n = 1 then code end as code, dist from part left join k on read = replace(p_name, 'e', 'c')
    """,
    {"dist": "integer"},
)
def code_repair(spark, sf_dir):
    """Misread codes against the registry: the one nearest within two edits, if it is the only one.

    Each spelling is repaired once. It meets the codes that it shares a form with after two deletions or fewer, as all
    codes within two edits do, so the join has a selective key.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("code"), F.translate("p_name", "e", "c").alias("read"))
    forms = lambda c: part.select(c).distinct().select(c, F.explode(deletions(F.col(c), 2)).alias("form"))
    near = forms("read").join(forms("code"), "form").select("read", "code").distinct().withColumn("dist", F.levenshtein("read", "code")).where("dist <= 2")
    best = near.withColumn("best", F.min("dist").over(W.partitionBy("read"))).where("dist = best")
    found = best.groupBy("read").agg(F.min("code").alias("found"), F.min("dist").alias("dist"), F.count("*").alias("n"))
    return part.join(found, "read", "left").select("p_partkey", F.when(F.col("n") == 1, F.col("found")).alias("code"), "dist")


@query(
    "evidence_localized",
    """
    with b as (select l_orderkey as file, l_linenumber as page, l_quantity as x, l_returnflag as s from lineitem where l_returnflag in ('A', 'R')),
    g as (select file, page, x from b where s = 'A'), p as (select distinct file, page, x from b where s = 'R'),
    m as (select g.file, g.page, g.x, bool_or(p.x is not null and greatest(0, 10 - abs(g.x - p.x)) / (10 + abs(g.x - p.x)) >= 0.5) as hit from g left join p on g.file = p.file and g.page = p.page group by 1, 2, 3)
    select file, count(*) as gold, count(*) filter (where hit) as found, bool_and(hit) as localized from m group by 1
    """,
)
def evidence_localized(spark, sf_dir):
    """Whether every gold box of a file has a predicted one on its page that overlaps by half."""
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), "l_returnflag")
    g = b.where("l_returnflag = 'A'").select("file", "page", "x").distinct()
    p = b.where("l_returnflag = 'R'").select("file", "page", F.col("x").alias("px")).distinct()
    off = F.abs(F.col("x") - F.col("px"))
    hit = F.coalesce(F.greatest(F.lit(0.0), 10 - off) / (10 + off) >= 0.5, F.lit(False))
    m = g.join(p, ["file", "page"], "left").groupBy("file", "page", "x").agg(F.bool_or(hit).alias("hit"))
    return m.groupBy("file").agg(F.count("*").alias("gold"), F.count_if("hit").alias("found"), F.bool_and("hit").alias("localized"))


@query(
    "retraining_counts",
    """
    select o_orderpriority as reason, count(*) filter (where o_orderstatus = 'F') as accepted, count(*) filter (where o_orderstatus = 'O') as rejected, count(*) filter (where o_orderstatus = 'P') as pending,
           round(case when count(*) = 0 then 0 else count(*) filter (where o_orderstatus = 'F') / count(*) end, 9) as share from orders group by 1
    """,
)
def retraining_counts(spark, sf_dir):
    """Decisions by reason, pivoted over a closed list of states so the plan needs no pass to find them."""
    wide = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("reason")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    a, r, p = F.col("F"), F.col("O"), F.col("P")
    return wide.select("reason", a.alias("accepted"), r.alias("rejected"), p.alias("pending"), F.round(ratio(a, a + r + p, 0.0), 9).alias("share"))


#: name, numerator and denominator as conditions over line items
METRICS = {
    "recall": ("l_returnflag = 'R' and l_discount > 0.05", "l_returnflag = 'R'"),
    "precision": ("l_returnflag = 'R' and l_discount > 0.05", "l_discount > 0.05"),
    "open_share": ("l_linestatus = 'O'", "true"),
    "late_share": ("l_shipdate > timestamp '2000-01-01'", "true"),
    "taxed_open": ("l_linestatus = 'O' and l_tax > 0", "l_linestatus = 'O'"),
    "undefined": ("false", "l_quantity < 0"),
}


@query(
    "metric_registry",
    "\nunion all\n".join(f"select '{k}' as metric, case when count(*) filter (where {d}) > 0 then round(count(*) filter (where {n}) / count(*) filter (where {d}), 9) end as value from lineitem" for k, (n, d) in METRICS.items()),
)
def metric_registry(spark, sf_dir):
    """Named ratios from one pass: the registry is a map of conditions."""
    parts = [x for k, (n, d) in METRICS.items() for x in (F.count_if(F.expr(n)).alias(f"{k}_n"), F.count_if(F.expr(d)).alias(f"{k}_d"))]
    sums = table(spark, sf_dir, "lineitem").agg(*parts)
    cells = F.array(*[F.struct(F.lit(k).alias("metric"), F.round(ratio(F.col(f"{k}_n"), F.col(f"{k}_d")), 9).alias("value")) for k in METRICS])
    return sums.select(F.inline(cells))


@query(
    "eviction_order",
    """
    with f as (select c_nationkey as disk, c_custkey as file, cast(floor(abs(c_acctbal)) as bigint) as bytes, c_mktsegment = 'BUILDING' as keep from customer),
    o as (select *, sum(bytes) over (partition by disk order by keep desc, file desc) as held from f)
    select disk, file, bytes from o where held > 60000 and not keep
    """,
)
def eviction_order(spark, sf_dir):
    """Oldest files beyond a disk's capacity; kept ones never go."""
    f = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("disk"), F.col("c_custkey").alias("file"), F.floor(F.abs("c_acctbal")).alias("bytes"), (F.col("c_mktsegment") == "BUILDING").alias("keep"))
    held = F.sum("bytes").over(W.partitionBy("disk").orderBy(F.desc("keep"), F.desc("file")))
    return f.withColumn("held", held).where("held > 60000 and not keep").select("disk", "file", "bytes")


@query(
    "pressure_classes",
    r"""
    with t as (select p_partkey, p_size, case p_size % 4 when 0 then 'PN' || p_size when 1 then (p_size / 10.0) || ' MPa' when 2 then p_size || ' bar' else 'none' end as s from part)
    select p_partkey, case p_size % 4 when 3 then null else cast(p_size as double) end as class from t
    """,
)
def pressure_classes(spark, sf_dir):
    """Nominal pressure from PN, MPa and bar spellings, the least of those named."""
    size = F.col("p_size")
    s = F.when(size % 4 == 0, F.concat(F.lit("PN"), size.cast("string"))).when(size % 4 == 1, F.concat((size / 10).cast("string"), F.lit(" MPa"))).when(size % 4 == 2, F.concat(size.cast("string"), F.lit(" bar"))).otherwise("none")
    read = lambda pattern, k: F.transform(F.regexp_extract_all("s", F.lit(pattern), F.lit(1)), lambda m: F.round(m.cast("double") * k, 6))
    found = F.concat(read(r"PN\s*(\d+(?:\.\d+)?)", 1.0), read(r"(\d+(?:\.\d+)?)\s*MPa", 10.0), read(r"(\d+(?:\.\d+)?)\s*bar", 1.0))
    return table(spark, sf_dir, "part").select("p_partkey", s.alias("s")).select("p_partkey", F.array_min(found).alias("class"))


@query(
    "claim_validation",
    """
    select item_id, count(doc_id) as supported from benchmark b left join documents d on contains(d.text, b.text) group by 1
    """,
)
def claim_validation(spark, sf_dir):
    """Documents that hold the whole quotation of each claim.

    A document that holds it has its second to sixth words, between the same single spaces: they are the key of a join,
    and what meets there is compared whole. Claims of fewer than seven words have no such key and are compared by
    their letters only, after a broadcast that is made only if they are few.
    """
    words = F.split("text", " ")
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), words.alias("w"))
    long = quotes.where(F.size("w") >= 7).select("item_id", "quote", F.xxhash64(F.array_join(F.slice("w", 2, 5), " ")).alias("key"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", words.alias("w"))
    starts = F.when(F.size("w") >= 5, F.sequence(F.lit(1), F.size("w") - 4)).otherwise(F.array().cast("array<int>"))
    grams = docs.select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, 5), " "))))).alias("key"))
    met = grams.join(long, "key").select("doc_id", "item_id", "quote").distinct()
    held = met.join(docs.select("doc_id", "text"), "doc_id").where(F.contains("text", "quote")).select("doc_id", "item_id")
    short = quotes.where(F.size("w") < 7).select("item_id", "quote")
    if not short.isEmpty():
        held = held.unionAll(docs.join(short, F.contains("text", "quote")).select("doc_id", "item_id"))
    counts = held.groupBy("item_id").agg(F.count("doc_id").alias("supported"))
    return quotes.join(counts, "item_id", "left").select("item_id", F.coalesce("supported", F.lit(0).cast("long")).alias("supported"))


@query(
    "logistic_scores",
    """
    with f as (select l_orderkey, l_linenumber, l_partkey, 0.8 * ln(1 + l_quantity) - 12 * l_discount + case when l_returnflag = 'R' then 1.5 else 0 end - 2.1 as z from lineitem)
    select l_orderkey, l_linenumber, l_partkey, round(1 / (1 + exp(-z)), 9) as score from f where 1 / (1 + exp(-z)) >= 0.6
    """,
)
def logistic_scores(spark, sf_dir):
    """Scores of candidate cards by fixed weights over log features."""
    z = 0.8 * F.log1p("l_quantity") - 12 * F.col("l_discount") + F.when(F.col("l_returnflag") == "R", 1.5).otherwise(0) - 2.1
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (1 / (1 + F.exp(-z))).alias("score"))
    return rows.where("score >= 0.6").withColumn("score", F.round("score", 9))


@query("ranker_training")
def ranker_training(spark, sf_dir):
    """A logistic ranker trained over labelled cards by Spark's own optimiser, with the features' weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    docs = table(spark, sf_dir, "documents").select("doc_id", F.log1p("n_chars").alias("size"), (F.size(F.split("text", "\n")) / 10).alias("lines"))
    cards = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("size", "lines", F.col("quality").cast("double").alias("label"))
    fitted = LogisticRegression(maxIter=30, regParam=0.01).fit(VectorAssembler(inputCols=["size", "lines"], outputCol="features").transform(cards))
    weights = [("size", float(fitted.coefficients[0])), ("lines", float(fitted.coefficients[1])), ("bias", float(fitted.intercept))]
    return spark.createDataFrame(weights, "feature string, weight double")


@query(
    "discipline_fit",
    """
    with m as (select l_orderkey, l_suppkey % 6 as mark, count(*) as n from lineitem group by 1, 2), d(mark, disc) as (values (0, 'AR'), (1, 'AR'), (2, 'KR'), (3, 'OV'), (4, 'VK')),
    s as (select l_orderkey, disc, sum(n) as n from m join d using (mark) group by 1, 2)
    select l_orderkey, arg_max(disc, n * 1000 - ascii(disc) - ascii(substring(disc, 2)) / 1000.0) as disc, max(n) as votes from s group by 1
    """,
    {"votes": "bigint"},
)
def discipline_fit(spark, sf_dir):
    """The discipline most marks of a document fit; marks of none don't vote."""
    marks = F.create_map(*[F.lit(x) for pair in ((0, "AR"), (1, "AR"), (2, "KR"), (3, "OV"), (4, "VK")) for x in pair])
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", F.try_element_at(marks, (F.col("l_suppkey") % 6).cast("int")).alias("disc")).where("disc is not null")
    votes = m.groupBy("l_orderkey", "disc").agg(F.count("*").alias("votes"))
    return first_per(votes, ["l_orderkey"], [F.desc("votes"), F.asc("disc")])


@query(
    "relation_distances",
    """
    with a as (select l_orderkey as page, l_linenumber as i, min(l_quantity) as x from lineitem where l_returnflag = 'A' group by 1, 2), b as (select l_orderkey as page, min(l_quantity) as x, count(*) as n from lineitem where l_returnflag = 'N' group by 1)
    select a.page, count(*) as pairs, min(abs(a.x - b.x)) as nearest, bool_or(abs(a.x - b.x) < 5) as too_close from a join b on a.page = b.page group by 1
    """,
)
def relation_distances(spark, sf_dir):
    """Distances of elements of one kind to the reference of another on the same page."""
    lines = table(spark, sf_dir, "lineitem")
    a = lines.where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("page"), "l_linenumber").agg(F.min("l_quantity").alias("x"))
    b = lines.where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("page")).agg(F.min("l_quantity").alias("bx"))
    d = F.abs(F.col("x") - F.col("bx"))
    return a.join(b, "page").groupBy("page").agg(F.count("*").alias("pairs"), F.min(d).alias("nearest"), F.bool_or(d < 5).alias("too_close"))
