"""Small predicates of the domain over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import checks
from factloom.functions.text import fold, format_number
from factloom.operators.picks import first_per
from factloom.plans.registry import query
from factloom.sources.tables import table


@query(
    "stage_sources",
    """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_partkey % 4 when 0 then false when 1 then false else true end as required,
        case l_suppkey % 4 when 0 then false when 1 then l_partkey % 3 = 0 when 2 then true else l_partkey % 3 < 2 end as named, l_linenumber % 4 > 1 or l_linenumber % 4 = 0 and l_suppkey % 4 = 1 as counts from lineitem
    """,
)
def stage_sources(spark, sf_dir):
    """Whether a line's stage asks for a source, its discipline is one, and its type of document counts."""
    of = lambda values, at: F.get(F.array(*values), at.cast("int"))
    part, supplier, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    source = of([F.lit(" — "), F.lit(None).cast("string"), F.lit("drawings"), F.lit("x")], part % 4)
    discipline = of([F.lit("A"), F.lit("B"), F.lit(None).cast("string")], part % 3)
    names = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    lists = of([names(), names("A"), names("A", "*"), names("A", "B")], supplier % 4)
    kind = of([F.lit("estimate"), F.lit("questionnaire"), F.lit(None).cast("string"), F.lit("plan")], line % 4)
    allowed = of([names(), names("estimate"), names("plan"), names()], supplier % 4)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", checks.stage_required(source).alias("required"), checks.is_named_source(lists, discipline).alias("named"), checks.is_document_source(kind, allowed).alias("counts")
    )


@query(
    "gold_items",
    """
    with c as (select o_orderkey, o_custkey, case o_orderstatus when 'F' then 'POSITIVE' when 'O' then 'NEGATIVE' end as label, o_custkey % 5 > 0 and o_orderkey % 4 > 0 as has from orders)
    select o_orderkey, label as gold_label from c join customer on c_custkey = o_custkey where has and label is not null and c_nationkey % 6 > 1
    """,
)
def gold_items(spark, sf_dir):
    """Settled cards of real objects that may teach."""
    status = F.when(F.col("o_orderstatus") == "F", "CONFIRMED_VIOLATION").when(F.col("o_orderstatus") == "O", "NEGATIVE_VERIFIED").otherwise("OPEN")
    expert = F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey").cast("string")).when(F.col("o_custkey") % 2 == 0, "")
    objects = table(spark, sf_dir, "customer").withColumn("name", F.when(F.col("c_nationkey") % 6 == 0, F.concat(F.lit("  синтетика "), "c_name")).otherwise(F.col("c_name")))
    real = objects.where(checks.is_real(F.col("name"), F.when(F.col("c_nationkey") % 6 == 1, True)))
    cards = table(spark, sf_dir, "orders").join(real, F.col("o_custkey") == F.col("c_custkey"))
    return cards.select("o_orderkey", checks.gold_label(status, F.col("o_orderkey") % 4, expert).alias("gold_label")).where("gold_label is not null")


@query(
    "load_scenarios",
    """
    with c as (select l_orderkey, count(*) filter (where l_returnflag = 'A' and l_linenumber < 6) as a, count(*) filter (where l_returnflag = 'A') as da, count(*) filter (where l_returnflag = 'N' and l_linenumber < 6) as n, count(*) filter (where l_returnflag = 'N') as dn,
        count(*) filter (where l_returnflag = 'R' and l_linenumber < 6) as r, count(*) filter (where l_returnflag = 'R') as dr from lineitem group by 1),
    s as (select l_orderkey, case when a = 0 then 'MISSING' when a < da then 'PARTIAL' else 'UPLOADED' end as pd, case when n = 0 then 'MISSING' when n < dn then 'PARTIAL' else 'UPLOADED' end as rd, case when r = 0 then 'MISSING' when r < dr then 'PARTIAL' else 'UPLOADED' end as id from c)
    select l_orderkey, 'PD_' || pd || ' RD_' || rd || ' ID_' || id as codes, case when 'PARTIAL' in (pd, rd, id) then 'PARTIALLY_LOADED' when pd = 'UPLOADED' and rd = 'UPLOADED' and id = 'UPLOADED' then 'FULL' when pd = 'UPLOADED' and rd = 'UPLOADED' then 'PD_RD_ONLY'
        when pd = 'UPLOADED' and id = 'UPLOADED' then 'PD_ID_ONLY' when rd = 'UPLOADED' and id = 'UPLOADED' then 'RD_ID_ONLY' when pd = 'MISSING' and rd = 'MISSING' and id = 'MISSING' then 'NO_DOCUMENTS' else 'SINGLE_ONLY' end as scenario from s
    """,
)
def load_scenarios(spark, sf_dir):
    """What of each stage is loaded, and what can be compared with it."""
    flags = {"PD": "A", "RD": "N", "ID": "R"}
    counts = [c for s, f in flags.items() for c in (F.count_if((F.col("l_returnflag") == f) & (F.col("l_linenumber") < 6)).alias(f"{s}_n"), F.count_if(F.col("l_returnflag") == f).alias(f"{s}_of"))]
    loads = {s: checks.stage_load(F.col(f"{s}_n"), F.col(f"{s}_of"), F.lit(0)) for s in flags}
    codes = F.concat_ws(" ", *[F.concat(F.lit(f"{s}_"), load) for s, load in loads.items()])
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*counts).select("l_orderkey", codes.alias("codes"), checks.scenario(loads).alias("scenario"))


@query(
    "value_lists",
    """
    with v as (select l_orderkey, l_returnflag, l_quantity, l_linenumber, min(l_linenumber) over (partition by l_orderkey, l_returnflag, l_quantity) as first from lineitem),
    g as (select l_orderkey, l_returnflag, l_quantity, min(first) as first, array_to_string(list(distinct l_linenumber order by l_linenumber), ', ') as pages from v group by 1, 2, 3)
    select l_orderkey, string_agg(l_returnflag || ' — ' || cast(cast(l_quantity as integer) as varchar) || ' (p. ' || pages || ')', '; ' order by first, l_returnflag, l_quantity) as listed from g group by 1
    """,
)
def value_lists(spark, sf_dir):
    """Values of each order with the pages that give them, in order of the first page."""
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_quantity").agg(F.array_sort(F.collect_set("l_linenumber")).alias("pages"))
    text = F.concat("l_returnflag", F.lit(" — "), format_number(F.col("l_quantity")), F.lit(" (p. "), F.array_join(F.col("pages").cast("array<string>"), ", "), F.lit(")"))
    item = F.struct(F.col("pages")[0].alias("first"), "l_returnflag", "l_quantity", text.alias("text"))
    return groups.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]), "; ").alias("listed"))


@query(
    "unseen_documents",
    """
    with j as (select '["' || doc_id || '","' || (doc_id + 3) || '"]' as seen from documents where doc_id % 11 = 0),
    s as (select distinct unnest(from_json(seen, '["VARCHAR"]')) as id from j)
    select doc_id from documents where not exists (select 1 from s where s.id = cast(doc_id as varchar))
    """,
)
def unseen_documents(spark, sf_dir):
    """Documents that no JSON list of the recent ones has."""
    docs = table(spark, sf_dir, "documents")
    lists = docs.where("doc_id % 11 = 0").select(F.to_json(F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 3).cast("string"))).alias("seen"))
    seen = lists.select(F.explode(F.from_json("seen", "array<string>")).alias("id")).distinct()
    return docs.join(seen, F.col("doc_id").cast("string") == F.col("id"), "left_anti").select("doc_id")


@query(
    "durations_and_times",
    """
    select event_id, round(value * case event_id % 5 when 0 then 1.0 when 1 then 7.0 when 2 then 30.0 when 3 then 365.0 end, 3) as days,
        case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT00:00:00.000Z') when 1 then strftime(ts - interval 3 hour, '%Y-%m-%dT%H:%M:%S.000Z') when 2 then strftime(ts, '%Y-%m-%dT%H:%M:00.000Z') end as at,
        case when event_id % 6 = 0 then null when event_id % 7 = 0 then 'security' when event_id % 6 < 3 then 'warn' when event_id % 8 <= 3 then 'error' else 'info' end as route from events
    """,
)
def durations_and_times(spark, sf_dir):
    """Durations in days, times of events in UTC, and where their log lines go."""
    i = F.col("event_id")
    of = lambda values, at: F.get(F.array(*values), at.cast("int"))
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm")
    text = of([day, F.concat(day, F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("+03:00")), F.concat(day, F.lit(" "), clock), F.concat(day, F.lit("T25:00"))], i % 4)
    level = F.when(i % 6 == 0, "debug").when(i % 6 < 3, "warn")
    unit = of([F.lit(u) for u in ("day", "week", "month", "year", "mile")], i % 5)
    return table(spark, sf_dir, "events").select(
        "event_id", checks.to_days(F.col("value"), unit).alias("days"), checks.event_time(text).alias("at"), checks.log_route(level, i % 8, i % 7 == 0).alias("route")
    )


@query(
    "distinct_items",
    """
    with i as (select *, lower(p_type) as key from part)
    select p_partkey, key from i qualify row_number() over (partition by key order by p_brand, p_size, p_partkey) = 1
    """,
)
def distinct_items(spark, sf_dir):
    """Items that different documents give in the same words, once: the first by document and page."""
    items = table(spark, sf_dir, "part").withColumn("key", fold(F.upper("p_type")))
    return first_per(items, ["key"], [F.asc("p_brand"), F.asc("p_size"), F.asc("p_partkey")]).select("p_partkey", "key")


@query(
    "field_matches",
    """
    select l_returnflag as kind_no, l_linenumber % 6 as form, count(*) as n, count(*) filter (where case l_linenumber % 6 when 0 then true when 1 then true when 2 then l_quantity < 25 when 3 then true when 4 then l_suppkey % 2 = 0 else false end) as same from lineitem group by 1, 2
    """,
    {"form": "integer"},
)
def field_matches(spark, sf_dir):
    """Read fields that are the gold ones in the form of their kind."""
    n, q = F.col("l_linenumber") % 6, F.col("l_quantity").cast("int").cast("string")
    kind = F.get(F.array(*map(F.lit, ("code", "stage", "sheet", "room", "revision", "text"))), n.cast("int"))
    gold = F.when(n == 0, F.concat(F.lit("АВ - "), q)).when(n == 1, "RD").when(n == 2, F.concat(F.lit("л. 0"), q)).when(n == 3, F.concat(F.lit("1.18а "), q)).when(n == 4, "В").otherwise("x")
    read = F.when(n == 0, F.concat(F.lit("AB-"), q)).when(n == 1, "р").when(n == 2, F.when(F.col("l_quantity") < 25, q).otherwise("99")).when(n == 3, F.concat(F.lit("1.18A"), q)).when(n == 4, F.when(F.col("l_suppkey") % 2 == 0, "B").otherwise("b"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind_no"), n.alias("form"), checks.same_field(kind, gold, read).alias("same"))
    return rows.groupBy("kind_no", "form").agg(F.count("*").alias("n"), F.count_if("same").alias("same"))


@query(
    "value_ranges",
    """
    select l_linenumber % 5 as form, count(*) as n, round(sum(case l_linenumber % 5 when 0 then l_quantity when 1 then least(l_quantity, 20) when 2 then least(l_quantity, 30) when 3 then l_quantity / 2 end), 6) as low,
        round(sum(case l_linenumber % 5 when 0 then l_quantity when 1 then greatest(l_quantity, 20) when 2 then greatest(l_quantity, 30) when 3 then l_quantity / 2 end), 6) as high, count(*) filter (where l_linenumber % 5 in (2, 3)) as units from lineitem group by 1
    """,
    {"form": "integer"},
)
def value_ranges(spark, sf_dir):
    """Numbers and ranges read from cells."""
    n, q = F.col("l_linenumber") % 5, F.col("l_quantity").cast("int").cast("string")
    half = F.regexp_replace((F.col("l_quantity") / 2).cast("string"), r"\.", ",")
    text = F.when(n == 0, q).when(n == 1, F.concat(F.lit("от "), q, F.lit(" до 20"))).when(n == 2, F.concat(q, F.lit("...30 mm"))).when(n == 3, F.concat(F.lit("± "), half, F.lit(" kg"))).otherwise(F.concat(q, F.lit(" floors")))
    rows = table(spark, sf_dir, "lineitem").select(n.alias("form"), checks.range_of(text).alias("v"))
    return rows.groupBy("form").agg(F.count("*").alias("n"), F.round(F.sum("v.low"), 6).alias("low"), F.round(F.sum("v.high"), 6).alias("high"), F.count("v.unit").alias("units"))
