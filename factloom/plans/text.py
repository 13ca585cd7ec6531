"""Text extraction and search over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.functions.text import document_type, fold, format_number, iso_date, jaccard, mask_ip, mask_mail, overlap_of_shorter, parse_number, stem, to_cyrillic_key, to_latin_code, unit_factor, word_distance, words
from factloom.operators.picks import first_per
from factloom.operators.search import bm25
from factloom.plans.registry import query
from factloom.sources.tables import table

FOLD_SQL = r"trim(regexp_replace(regexp_replace(translate(lower({0}), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query("fold_text", f"select doc_id, md5({FOLD_SQL.format('text')}) as folded, length({FOLD_SQL.format('text')}) as n from documents", {"n": "integer"})
def fold_text(spark, sf_dir):
    folded = fold(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folded.cast("binary")).alias("folded"), F.length(folded).alias("n"))


@query(
    "code_keys",
    r"""
    select c_custkey, regexp_replace(translate(upper(c_name), 'АВСЕНКМОРТХУасеорху', 'ABCEHKMOPTXYaceopxy'), '\s+', '', 'g') as code,
           regexp_extract(c_name, '#0*([0-9]+)', 1) as number,
           trim(regexp_replace(lower(translate(c_name, 'ABCEHKMOPTXYaceopxy', 'АВСЕНКМОРТХУасеорху')), '[^\p{L}\p{N}]+', ' ', 'g')) as row_key from customer
    """,
)
def code_keys(spark, sf_dir):
    """Keys that look-alike letters of two alphabets can't split."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", to_latin_code(F.col("c_name")).alias("code"), F.regexp_extract("c_name", "#0*([0-9]+)", 1).alias("number"), to_cyrillic_key(F.col("c_name")).alias("row_key")
    )


@query(
    "numbers_and_units",
    """
    with v as (select o_orderkey, o_totalprice, cast(floor(o_totalprice) as bigint) as whole from orders),
    t as (select *, 'total ' || (whole // 1000) || ' ' || lpad(cast(whole % 1000 as varchar), 3, '0') || ',5 kg' as written from v where whole >= 1000)
    select o_orderkey, whole + 0.5 as parsed, (whole + 0.5) * 1.0 as base, replace(regexp_replace(regexp_replace(printf('%.2f', floor(o_totalprice * 100 + 0.5) / 100), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', ''), '.', ',') as shown from t
    """,
    {"parsed": "double", "base": "double"},
)
def numbers_and_units(spark, sf_dir):
    """Numbers written with grouped thousands and a decimal comma, their unit's factor, and the other way round."""
    whole = F.floor("o_totalprice")
    grouped = F.concat(F.floor(whole / 1000).cast("string"), F.lit(" "), F.lpad((whole % 1000).cast("string"), 3, "0"))
    rows = table(spark, sf_dir, "orders").where(whole >= 1000).withColumn("written", F.concat(F.lit("total "), grouped, F.lit(",5 kg")))
    parsed = parse_number(F.col("written"))
    return rows.select("o_orderkey", parsed.alias("parsed"), (parsed * unit_factor(F.regexp_extract("written", r"(\p{L}+)$", 1))).alias("base"), format_number(F.col("o_totalprice")).alias("shown"))


@query(
    "token_counts",
    rf"""
    with w as (select source, unnest(string_split({FOLD_SQL.format('text')}, ' ')) as word from documents)
    select source, count(*) as n, count(distinct word) as vocabulary, max(length(word)) as longest from w where length(word) >= 3 group by 1
    """,
    {"longest": "integer"},
)
def token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.explode(words(F.col("text"), 3)).alias("word"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("word").alias("vocabulary"), F.max(F.length("word")).alias("longest"))


@query(
    "bm25_search",
    rf"""
    with w as (select doc_id, string_split({FOLD_SQL.format('text')}, ' ') as ws from documents),
    l as (select doc_id, len(ws) as len from w), t as (select doc_id, unnest(ws) as word from w),
    f as (select doc_id, word, count(*) as tf from t where word in ('license', 'public', 'general', 'thing') group by 1, 2),
    s as (select count(*) as n, avg(len) as mean from l), d as (select word, count(*) as df from f group by 1)
    select f.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 9) as score
    from f join d using (word) join l using (doc_id) cross join s group by 1 order by score desc, f.doc_id limit 20
    """,
)
def bm25_search(spark, sf_dir):
    """The twenty best documents for a query of four words."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return bm25(docs, "doc_id", "text", "license public general thing", 20).withColumn("score", F.round("score", 9))


@query(
    "edit_distances",
    """
    with x as (select conv_id, turn, regexp_replace(text, '[^ -~]', '', 'g') as a from conversations),
    c as (select conv_id, turn, a, lead(a) over (partition by conv_id order by turn) as b from x)
    select conv_id, sum(levenshtein(a, b)) as errors, sum(length(a)) as total, round(1 - sum(levenshtein(a, b)) / sum(length(a)), 9) as accuracy from c where b is not null and length(a) > 0 group by 1
    """,
    {"errors": "bigint", "total": "bigint"},
)
def edit_distances(spark, sf_dir):
    """Character accuracy pooled over the pairs of a conversation."""
    cut = F.regexp_replace("text", "[^ -~]", "")
    c = table(spark, sf_dir, "conversations").select("conv_id", cut.alias("a"), F.lead(cut).over(W.partitionBy("conv_id").orderBy("turn")).alias("b"))
    c = c.where("b is not null and length(a) > 0")
    errors, total = F.sum(F.levenshtein("a", "b")), F.sum(F.length("a"))
    return c.groupBy("conv_id").agg(errors.alias("errors"), total.alias("total"), F.round(1 - errors / total, 9).alias("accuracy"))


@query(
    "masking",
    r"""
    with p as (select doc_id, string_split(text, '@') as ps from documents where contains(text, '@')),
    n as (select doc_id, ps, list_transform(ps, lambda x: regexp_extract(x, '[^\s,;:<>()\[\]"@]+$')) as names from p)
    select doc_id, md5(array_to_string(list_transform(range(1, len(ps) + 1), lambda i: case when names[i] <> '' and regexp_matches(coalesce(ps[i + 1], ''), '^[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+')
        then ps[i][:len(ps[i]) - len(names[i]) + 1] || '***' else ps[i] end), '@')) as masked from n
    """,
)
def masking(spark, sf_dir):
    """Texts with the names before their addresses masked."""
    rows = table(spark, sf_dir, "documents").where(F.col("text").contains("@"))
    return rows.select("doc_id", F.md5(mask_mail(F.col("text")).cast("binary")).alias("masked"))


@query(
    "masked_addresses",
    r"""
    with a as (select doc_id, regexp_extract(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b') as ip from documents)
    select doc_id, case when len(list_filter(string_split(ip, '.'), lambda o: cast(o as integer) > 255)) > 0 then '***' else regexp_replace(ip, '\.\d+$', '.0') end as ip from a where ip <> ''
    """,
)
def masked_addresses(spark, sf_dir):
    """The first address of each document without its last byte."""
    ip = F.regexp_extract("text", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0)
    return table(spark, sf_dir, "documents").select("doc_id", ip.alias("ip")).where("ip <> ''").select("doc_id", mask_ip(F.col("ip")).alias("ip"))


@query("word_errors")
def word_errors(spark, sf_dir):
    """Word accuracy of each turn against the one before, pooled over a conversation."""
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("after", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
    turns = turns.select("conv_id", words("text").alias("a"), words("after").alias("b")).where("size(a) > 0")
    errors, total = F.sum(word_distance(F.col("a"), F.col("b"))), F.sum(F.size("a"))
    return turns.groupBy("conv_id").agg(errors.alias("errors"), total.alias("total"), F.round(1 - errors / total, 9).alias("accuracy"))


@query(
    "document_types",
    r"""
    select case when regexp_matches(lower(text), 'licen[cs]e') then 'LICENSE' when regexp_matches(lower(text), 'token\s*=') then 'SECRET'
      when regexp_matches(lower(text), '\S+@\S+\.\S+') then 'CONTACT' when contains(lower(text), ' | ') then 'TABLE' else 'PROSE' end as kind, count(*) as n, min(doc_id) as first_doc
    from documents group by 1
    """,
)
def document_types(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", document_type(F.col("text")).alias("kind"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    "normative_references",
    r"""
    with r as (select doc_id, unnest(regexp_extract_all(text, '(?:Version|version|NC|License,) ?\d?\.?\d?')) as ref from documents)
    select trim(ref) as ref, count(*) as n, count(distinct doc_id) as docs from r group by 1
    """,
)
def normative_references(spark, sf_dir):
    """References of a fixed form, with how often and in how many documents they occur."""
    found = F.regexp_extract_all("text", F.lit(r"(?:Version|version|NC|License,) ?\d?\.?\d?"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("ref"))
    return rows.groupBy(F.trim("ref").alias("ref")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query(
    "iso_dates",
    """
    select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso, strftime(o_orderdate, '%Y-%m-%d') as plain, cast(null as varchar) as wrong from orders
    """,
)
def iso_dates(spark, sf_dir):
    """Dates as people write them, in two forms, and one that is none."""
    text = lambda f: F.concat(F.lit("signed "), F.date_format("o_orderdate", f), F.lit(" by hand"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", iso_date(text("dd.MM.yyyy")).alias("iso"), iso_date(text("yyyy-MM-dd")).alias("plain"), iso_date(F.lit("on 31.02.2024")).alias("wrong")
    )


@query(
    "keyword_cover",
    """
    with k as (select item_id, list_distinct(list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), lambda x: length(x) >= 7)) as ks from benchmark)
    select a.item_id, b.item_id as act, round(case when len(list_distinct(list_concat(a.ks, b.ks))) > 0 then len(list_intersect(a.ks, b.ks)) / len(list_distinct(list_concat(a.ks, b.ks))) else 0 end, 9) as similarity
    from k a join k b on a.item_id < b.item_id where len(list_intersect(a.ks, b.ks)) >= 1
    """,
)
def keyword_cover(spark, sf_dir):
    """Works and acts that share keywords: pairs come from an equi-join on the keyword."""
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]+", " "))
    k = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(letters, " "), lambda x: F.length(x) >= 7)).alias("ks"))
    each = k.select("item_id", "ks", F.explode("ks").alias("word"))
    met = each.alias("a").join(each.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.item_id") < F.col("b.item_id")))
    pairs = met.select(F.col("a.item_id").alias("item_id"), F.col("b.item_id").alias("act"), F.col("a.ks").alias("x"), F.col("b.ks").alias("y")).distinct()
    return pairs.select("item_id", "act", F.round(jaccard(F.col("x"), F.col("y")), 9).alias("similarity"))


@query(
    "stem_overlap",
    r"""
    with s as (select p_partkey, list_transform(string_split(p_name, ' '), lambda w: case when length(w) >= 5 then regexp_replace(w, '(ing|ed|es|s)$', '') else w end) as st from part),
    n as (select st, count(*) as n from s group by 1),
    p as (select a.st, sum(b.n) as met from n a join n b on len(list_intersect(a.st, b.st)) / least(len(list_distinct(a.st)), len(list_distinct(b.st)))::double >= 1 group by 1)
    select p_partkey, cast(met - 1 as bigint) as alike from s join p using (st) where met > 1
    """,
    {"alike": "bigint"},
)
def stem_overlap(spark, sf_dir):
    """How many other names share all stems of the shorter one.

    Names of the same stems are one; distinct lists meet at a stem, and are counted by how many names have them.
    """
    s = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.split("p_name", " "), stem).alias("st"))
    lists = s.groupBy("st").agg(F.count("*").alias("n"))
    each = lists.select("st", "n", F.explode(F.array_distinct("st")).alias("word"))
    met = each.toDF("st", "m", "word").join(each.toDF("other", "n", "word"), "word").select("st", "other", "n").distinct()
    counts = met.where(overlap_of_shorter(F.col("st"), F.col("other")) >= 1).groupBy("st").agg((F.sum("n") - 1).alias("alike"))
    return s.join(counts, "st").where("alike > 0").select("p_partkey", "alike")


@query(
    "best_anchor_line",
    r"""
    with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents),
    a(param, anchor) as (values ('P1', 'license'), ('P2', 'public'), ('P3', 'thing')),
    s as (select doc_id, param, no, 1.0 * length(anchor) / length(line) as score from l join a on contains(lower(line), anchor))
    select doc_id, param, no, round(score, 9) as score from (select *, row_number() over (partition by doc_id, param order by score desc, no) as rn from s) t where rn = 1
    """,
    {"no": "integer"},
)
def best_anchor_line(spark, sf_dir):
    """The line of a document where a parameter's anchor says most."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    anchors = F.explode(F.array(*[F.struct(F.lit(p).alias("param"), F.lit(a).alias("anchor")) for p, a in (("P1", "license"), ("P2", "public"), ("P3", "thing"))]))
    hits = lines.where(F.lower("line").rlike("license|public|thing")).select("doc_id", (F.col("no") + 1).alias("no"), "line", anchors.alias("a"))
    hits = hits.where(F.contains(F.lower("line"), F.col("a.anchor")))
    scored = hits.select("doc_id", "a.param", "no", (F.length("a.anchor") / F.length("line")).alias("score"))
    return first_per(scored, ["doc_id", "param"], [F.desc("score"), F.asc("no")]).withColumn("score", F.round("score", 9))


@query(
    "identity_by_majority",
    """
    with c as (select c_mktsegment as doc, o_orderstatus as code, count(*) as n from orders join customer on o_custkey = c_custkey group by 1, 2)
    select doc, arg_max(code, n * 1000 - ascii(code)) as code, max(n) as votes, count(*) as candidates from c group by 1
    """,
)
def identity_by_majority(spark, sf_dir):
    """The code most pages name, the smaller of equals."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = rows.groupBy(F.col("c_mktsegment").alias("doc"), F.col("o_orderstatus").alias("code")).agg(F.count("*").alias("n"))
    return c.groupBy("doc").agg(F.max_by("code", F.struct("n", -F.ascii("code"))).alias("code"), F.max("n").alias("votes"), F.count("*").alias("candidates"))
