"""Reading of notations and lines, results kept by content, an index of words, and intervals by resampling."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions.classes import fold_class, nfkc
from factloom.operators.anchors import best_lines
from factloom.operators.search import search_index, write_index
from factloom.operators.stats import bootstrap
from factloom.operators.tables import columns, read_rows
from factloom.plans.registry import query
from factloom.plans.text import FOLD_SQL
from factloom.sources.cache import ResultCache
from factloom.sources.shared import shared_dir
from factloom.sources.tables import dealt, table

#: Spellings that the test tables' numbers are written with.
PREFIXES, SEPARATORS = ["В", "B ", "EI", "ЕІ", "КМ", "с"], [" ", "", "-", " – "]


@query(
    "class_keys",
    f"""
    with r as (select {PREFIXES}[l_partkey % 6 + 1] || {SEPARATORS}[l_suppkey % 4 + 1] || translate(replace(cast(l_quantity / 2 as varchar), '.', ','), '03', 'OЗ') as raw, l_partkey % 6 as p, l_quantity / 2 as q from lineitem),
    d as (select distinct raw, p, q from r),
    u as (select raw, translate(replace(upper(replace(replace(raw, ' ', ''), '–', '-')), ',', '.'), 'АВСЕНКМОРТХУІ', 'ABCEHKMOPTXYI') as s from d),
    h as (select raw, case when regexp_matches(s, '^[^-]*\\p{{L}}-[0-9]') then replace(s, '-', '') else s end as s from u),
    o as (select raw, list_transform(range(1, len(s) + 1), lambda i: case when s[i] = 'O' and (i > 1 and s[i - 1] between '0' and '9' or s[i + 1] between '0' and '9') then '0' else s[i] end) as c from h),
    z as (select raw, array_to_string(list_transform(range(1, len(c) + 1), lambda i: case when c[i] = 'З' and (i > 1 and c[i - 1] between '0' and '9' or c[i + 1] between '0' and '9') then '3' else c[i] end), '') as k from o),
    e as (select raw, case when regexp_matches(k, '^\\p{{L}}{{1,3}}O$') then k[:-2] || '0' when regexp_matches(k, '^\\p{{L}}{{1,3}}З$') then k[:-2] || '3' else k end as key from z)
    select key, count(*) as spellings from e group by 1
    """,
)
def class_keys(spark, sf_dir):
    """Keys of class notations and how many spellings each has."""
    pick = lambda names, at: F.get(F.array(*map(F.lit, names)), at.cast("int"))
    number = F.translate(F.regexp_replace((F.col("l_quantity") / 2).cast("string"), r"\.", ","), "03", "OЗ")
    raw = F.concat(pick(PREFIXES, F.col("l_partkey") % 6), pick(SEPARATORS, F.col("l_suppkey") % 4), number)
    spellings = table(spark, sf_dir, "lineitem").select(raw.alias("raw")).distinct()
    return spellings.groupBy(fold_class(nfkc(F.col("raw"))).alias("key")).agg(F.count("*").alias("spellings"))


@query(
    "cached_results",
    """
    with a as (select doc_id, case when doc_id % 7 = 0 then null else text end as text from documents),
    b as (select doc_id, case when doc_id % 10 = 0 then text || ' more' else text end as text from documents),
    f as (select distinct sha256(text) as h from a where text is not null)
    select doc_id, len(string_split(text, ' ')) as n_words, case when h is not null then 'first' else 'second' end as made from b left join f on f.h = sha256(b.text)
    """,
    {"n_words": "integer"},
)
def cached_results(spark, sf_dir):
    """Words of every text, from a cache that two runs fill: the second makes only what the first hasn't seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = ResultCache(spark, f"{shared_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}", "words-1")
    schema = "n_words int"
    make = lambda new: new.select("content_sha256", F.size(F.split("text", " ")).alias("n_words"))
    before = docs.withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    after = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    first = cache.add(before, "text", schema, make)
    cache.add(after, "text", schema, make)
    made = F.when(F.col("run") == first, "first").when(F.col("run").isNotNull(), "second")
    return cache.of(after, "text", schema).select("doc_id", "n_words", made.alias("made"))


ANCHORS = [("P1", "license"), ("P1", "the licence text"), ("P2", "public domain"), ("P3", "the thing"), ("P4", "the license of the thing"), ("P5", "die lichen")]


@query("anchor_lines")
def anchor_lines(spark, sf_dir):
    """The line of each document that says a parameter's anchor best, unless a rival's anchor says it better."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "text"))
    anchors = spark.createDataFrame(ANCHORS, "param string, anchor string")
    return best_lines(lines, anchors, ["doc_id"], 75.0).withColumn("score", F.round("score", 6))


@query(
    "indexed_search",
    rf"""
    with w as (select doc_id, string_split({FOLD_SQL.format('text')}, ' ') as ws from documents where text is not null),
    l as (select doc_id, len(ws) as len from w), t as (select doc_id, unnest(ws) as word from w),
    f as (select doc_id, word, count(*) as tf from t where word in ('license', 'public', 'general', 'thing') group by 1, 2),
    s as (select count(*) as n, avg(len) as mean from l), d as (select word, count(*) as df from f group by 1),
    b as (select f.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score from f join d using (word) join l using (doc_id) cross join s group by 1),
    m as (select max(score) as top from b)
    select b.doc_id, round(0.7 * score / top + 0.3 * coalesce(quality, 0), 9) as score from b cross join m left join labels using (doc_id) order by score desc, b.doc_id limit 20
    """,
)
def indexed_search(spark, sf_dir):
    """The twenty best documents by words and quality, read from the postings of four words."""
    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    write_index(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("other"))
    found = search_index(spark, folder, "License public GENERAL thing", 20, quality, 0.3)
    return found.select(F.col("id").alias("doc_id"), F.round("score", 9).alias("score"))


@query(
    "bootstrap_objects",
    """
    with o as (select source, row_number() over (order by source) - 1 as pos, sum(quality) as q, sum(toxic) as t, count(*) as n from documents join labels using (doc_id) group by 1),
    c as (select count(*) as objects from o),
    d as (select b, floor(('0x' || substr(md5('seed:' || b || ':' || i), 1, 8))::bigint / 4294967296.0 * objects) as pos from c, range(400) x(b), range(0, (select objects from c)) y(i)),
    s as (select b, sum(q) / sum(n) as quality, sum(t) / sum(n) as toxic from d join o using (pos) group by 1),
    w as (select sum(q) / sum(n) as quality, sum(t) / sum(n) as toxic from o),
    l as (select unnest(['quality', 'toxic', 'quality - toxic']) as metric, unnest([quality, toxic, quality - toxic]) as v from s),
    v as (select unnest(['quality', 'toxic', 'quality - toxic']) as metric, unnest([quality, toxic, quality - toxic]) as value from w)
    select metric, round(any_value(value), 9) as value, round(quantile_cont(v, 0.025), 9) as low, round(quantile_cont(v, 0.975), 9) as high, count(*) as replicates from l join v using (metric) group by 1
    """,
)
def bootstrap_objects(spark, sf_dir):
    """Intervals of two shares and of their difference over objects drawn with replacement."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    objects = rows.groupBy("source").agg(F.sum("quality").alias("q"), F.sum("toxic").alias("t"), F.count("*").alias("n"))
    found = bootstrap(objects, "source", {"quality": ("q", "n"), "toxic": ("t", "n")}, 400, "seed", differences=[("quality", "toxic")])
    return found.select("metric", *[F.round(c, 9).alias(c) for c in ("value", "low", "high")], "replicates")


CELLS = """
    b as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 as i, l_partkey, l_suppkey, l_quantity from lineitem),
    h as (select distinct k, k % 3 as hd from b),
    x as (select k, 0 as r, unnest([0, 1, 2, 3]) as c, unnest(['№', 'Наименование', 'Ед. изм.', case when k % 2 = 0 then 'Значение' else 'Всего' end]) as text from h where hd > 0
        union all select k, 1, unnest([0, 1, 2, 3]), unnest(['1', '2', '3', '4']) from h where hd > 1
        union all select k, hd + i, unnest([0, 1, 2, 3]), unnest(case when i % 4 = 3 then ['', 'раздел ' || (l_suppkey % 3), '', '-'] else [cast(i as varchar), 'деталь ' || l_partkey, case when l_suppkey % 3 = 0 then 'mm' else 'kg' end, replace(cast(l_quantity / 2 as varchar), '.', ',')] end) from b join h using (k))
"""


def _cells(spark, sf_dir):
    """Tables of an order's lines: some with a header, some with a row that numbers the columns, every fourth row a section."""
    texts = lambda *names: F.array(*map(F.lit, names))
    lines = dealt(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "k")
    i = F.row_number().over(W.partitionBy("k").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")) - 1
    lines = lines.withColumn("i", i)
    unit = F.when(F.col("l_suppkey") % 3 == 0, "mm").otherwise("kg")
    row = F.array(F.col("i").cast("string"), F.concat(F.lit("деталь "), F.col("l_partkey").cast("string")), unit, F.translate((F.col("l_quantity") / 2).cast("string"), ".", ","))
    section = F.array(F.lit(""), F.concat(F.lit("раздел "), (F.col("l_suppkey") % 3).cast("string")), F.lit(""), F.lit("-"))
    last = F.when(F.col("k") % 2 == 0, "Значение").otherwise("Всего")
    at = lambda r, cells: F.struct(r.cast("long").alias("r"), cells.alias("cells"))
    first, depth = F.col("i") == 0, F.col("k") % 3
    parts = F.array_compact(F.array(
        F.when(first & (depth > 0), at(F.lit(0), F.concat(texts("№", "Наименование", "Ед. изм."), F.array(last)))),
        F.when(first & (depth > 1), at(F.lit(1), texts("1", "2", "3", "4"))),
        at(depth + F.col("i"), F.when(F.col("i") % 4 == 3, section).otherwise(row)),
    ))
    return lines.select("k", F.inline(parts)).select("k", "r", F.posexplode("cells").alias("c", "text"))


@query(
    "table_columns",
    f"""
    with {CELLS},
    n as (select k, count(*) filter (where i % 4 <> 3) as parts from b group by 1)
    select k, cast(c as integer) as c, case when k % 3 = 0 then '' else ['№', 'Наименование', 'Ед. изм.', case when k % 2 = 0 then 'Значение' else 'Всего' end][c + 1] end as title, ['number', 'name', 'unit', 'value'][c + 1] as role
    from n, (values (0), (1), (2), (3)) v(c) where parts > 0
    """,
)
def table_columns(spark, sf_dir):
    """What each column of a table holds, by its header where it has one and by its cells where not."""
    return columns(_cells(spark, sf_dir), ["k"])


@query(
    "table_rows",
    f"""
    with {CELLS},
    s as (select k, i, k % 3 + i as r, l_partkey, l_suppkey, l_quantity, last_value(case when i % 4 = 3 then 'раздел ' || (l_suppkey % 3) end ignore nulls) over (partition by k order by i rows between unbounded preceding and current row) as section from b)
    select k, r, section, cast(i as varchar) as number, 'деталь ' || l_partkey as name, case when l_suppkey % 3 = 0 then 'mm' else 'kg' end as unit, l_quantity / 2 as amount from s where i % 4 <> 3
    """,
)
def table_rows(spark, sf_dir):
    """Body rows with the section they stand in."""
    return read_rows(_cells(spark, sf_dir), ["k"]).select("k", "r", "section", "number", "name", "unit", F.col("values")[0]["amount"].alias("amount"))
