"""Monitoring series over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from factloom.operators.series import active_seconds, aggregate, auto_width, bucket, counter_delta, histogram, seconds
from factloom.plans.registry import query
from factloom.sources.tables import table

BOUNDS = [1.0, 5.0, 20.0, 50.0, 100.0, 250.0]


@query(
    "metric_buckets",
    """
    select cast(floor(epoch(ts) / 21600) * 21600 as bigint) as bucket, event_type, round(avg(value), 9) as mean, min(value) as low, max(value) as high, count(value) as n
    from events group by 1, 2
    """,
)
def metric_buckets(spark, sf_dir):
    return aggregate(table(spark, sf_dir, "events"), 21600, ["event_type"]).withColumn("mean", F.round("mean", 9))


@query(
    "metric_buckets_auto",
    """
    with s as (select max(epoch(ts)) - min(epoch(ts)) as span from events),
    w as (select case when span / 3600 <= 120 then 3600 when span / 21600 <= 120 then 21600 when span / 86400 <= 120 then 86400 else 604800 end as width from s)
    select cast(floor(epoch(ts) / width) * width as bigint) as bucket, count(*) as n from events cross join w group by 1
    """,
)
def metric_buckets_auto(spark, sf_dir):
    """Bucket width chosen from the span of the data: one aggregate row to the driver."""
    events = table(spark, sf_dir, "events")
    span = events.agg((F.max(seconds()) - F.min(seconds())).alias("s")).first()["s"] or 0
    return events.groupBy(bucket("ts", auto_width(span)).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "counter_deltas",
    """
    select event_id, case when p is null or value < p then value else round(value - p, 9) end as delta, coalesce(value < p, false) as reset
    from (select *, lag(value) over (partition by user_id, event_type order by ts, event_id) as p from events) t
    """,
)
def counter_deltas(spark, sf_dir):
    """Counter growth with resets."""
    before = F.lag("value").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("p", before)
    delta = F.round(counter_delta(F.col("value"), F.col("p")), 9)
    return rows.select("event_id", delta.alias("delta"), F.coalesce(F.col("value") < F.col("p"), F.lit(False)).alias("reset"))


@query(
    "idle_gaps",
    """
    with g as (select user_id, epoch(ts) - lag(epoch(ts)) over (partition by user_id order by ts, event_id) as gap from events)
    select user_id, round(coalesce(sum(gap) filter (where gap <= 14400), 0), 3) as active, count(*) as events from g group by 1
    """,
)
def idle_gaps(spark, sf_dir):
    """Working time: gaps up to the idle limit add up."""
    return active_seconds(table(spark, sf_dir, "events"), ["user_id"], 14400).withColumn("active", F.round("active", 3))


@query(
    "histogram",
    """
    with b(le) as (values (1.0::double), (5.0), (20.0), (50.0), (100.0), (250.0), ('inf'::double)), k as (select distinct event_type from events)
    select k.event_type, case when le = 'inf' then -1 else le end as le, (select count(*) from events e where e.event_type = k.event_type and e.value <= le) as n from k cross join b
    """,
)
def histogram_query(spark, sf_dir):
    """Cumulative histogram; -1 stands for the bucket without a bound."""
    found = histogram(table(spark, sf_dir, "events"), ["event_type"], "value", BOUNDS)
    return found.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query(
    "histogram_p95",
    """
    with c as (select event_type, count(*) * 0.95 as want, count(*) filter (where value <= 20) as n20, count(*) filter (where value <= 50) as n50,
                      count(*) filter (where value <= 100) as n100, count(*) filter (where value <= 250) as n250 from events group by 1)
    select event_type, round(case when n50 >= want then 20 + (50 - 20) * (want - n20) / (n50 - n20) when n100 >= want then 50 + (100 - 50) * (want - n50) / (n100 - n50)
           else 100 + (250 - 100) * (want - n100) / (n250 - n100) end, 9) as p95 from c
    """,
)
def histogram_p95(spark, sf_dir):
    """A percentile interpolated inside the bucket that holds it."""
    le = lambda b: F.count_if(F.col("value") <= b)
    c = table(spark, sf_dir, "events").groupBy("event_type").agg((F.count("*") * 0.95).alias("want"), *[le(b).alias(f"n{b}") for b in (20, 50, 100, 250)])
    step = lambda a, b: a + (b - a) * (F.col("want") - F.col(f"n{a}")) / (F.col(f"n{b}") - F.col(f"n{a}"))
    p95 = F.when(F.col("n50") >= F.col("want"), step(20, 50)).when(F.col("n100") >= F.col("want"), step(50, 100)).otherwise(step(100, 250))
    return c.select("event_type", F.round(p95, 9).alias("p95"))


@query(
    "slo_burn",
    """
    with w as (select cast(floor(epoch(ts) / 86400) * 86400 as bigint) as day, count(*) as total, count(*) filter (where event_type = 'error') as bad from events group by 1)
    select day, round(1.0 - bad / total, 9) as availability, round((bad / total) / 0.1, 9) as burn, round(1 - (sum(bad) over (order by day)) / (0.1 * sum(total) over (order by day)), 9) as budget_left from w
    """,
)
def slo_burn(spark, sf_dir):
    """Availability, burn rate and what is left of the error budget, by day."""
    w = table(spark, sf_dir, "events").groupBy(bucket("ts", 86400).alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("bad"))
    upto = W.orderBy("day")  # one row per day
    share = F.col("bad") / F.col("total")
    left = 1 - F.sum("bad").over(upto) / (0.1 * F.sum("total").over(upto))
    return w.select("day", F.round(1.0 - share, 9).alias("availability"), F.round(share / 0.1, 9).alias("burn"), F.round(left, 9).alias("budget_left"))


@query(
    "burn_windows",
    """
    select 'w' || h as width, cast(floor(epoch(ts) / (h * 3600)) as bigint) as slot, count(*) filter (where event_type = 'error') / count(*) as errors
    from events cross join (values (1), (6), (72)) t(h) group by 1, 2
    """,
)
def burn_windows(spark, sf_dir):
    """The same rate over windows of several widths, in one pass."""
    widths = F.explode(F.array(*map(F.lit, (1, 6, 72)))).alias("h")
    rows = table(spark, sf_dir, "events").select("event_type", "ts", widths)
    slot = F.floor(seconds() / (F.col("h") * 3600)).cast("long").alias("slot")
    width = F.concat(F.lit("w"), F.col("h").cast("string")).alias("width")
    return rows.groupBy(width, slot).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("errors"))


@query(
    "current_status",
    """
    select user_id, arg_max(event_type, (epoch_us(ts)::hugeint) * 100000 + event_id) as status, max(event_id) as last_id, count(*) as n from events group by 1
    """,
)
def current_status(spark, sf_dir):
    """Status by event time, however late the events came."""
    latest = F.max_by("event_type", F.struct("ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(latest.alias("status"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@query(
    "idempotent_intake",
    """
    select user_id, event_type, hour, min(event_id) as kept, count(*) as seen from (select *, cast(floor(epoch(ts) / 3600) as bigint) as hour from events) t group by 1, 2, 3
    """,
)
def idempotent_intake(spark, sf_dir):
    """Events of one reference, status and hour are one event."""
    hour = F.floor(seconds() / 3600).cast("long").alias("hour")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", hour).agg(F.min("event_id").alias("kept"), F.count("*").alias("seen"))


@query(
    "sliding_scores",
    """
    with m as (select user_id, cast(floor(epoch(ts) / 3600) as bigint) as h, sum(case event_type when 'error' then 5 when 'signup' then 2 else 1 end) as s from events group by 1, 2)
    select user_id, h, sum(s) over (partition by user_id order by h range between 5 preceding and current row) as score from m
    qualify score >= 12
    """,
    {"score": "bigint"},
)
def sliding_scores(spark, sf_dir):
    """Scores of the last six hours by user, where they reach the alarm level."""
    points = F.when(F.col("event_type") == "error", 5).when(F.col("event_type") == "signup", 2).otherwise(1)
    m = table(spark, sf_dir, "events").groupBy("user_id", F.floor(seconds() / 3600).cast("long").alias("h")).agg(F.sum(points).alias("s"))
    return m.select("user_id", "h", F.sum("s").over(W.partitionBy("user_id").orderBy("h").rangeBetween(-5, 0)).alias("score")).where("score >= 12")


@query(
    "cursor_advance",
    """
    with o as (select event_id, event_type <> 'error' as settled from events), f as (select min(event_id) as stop from o where not settled)
    select max(event_id) as cursor_at, count(*) as settled from o cross join f where event_id < stop
    """,
)
def cursor_advance(spark, sf_dir):
    """A cursor moves up to the first event that isn't settled."""
    events = table(spark, sf_dir, "events")
    stop = events.where("event_type = 'error'").agg(F.min("event_id").alias("stop"))
    ahead = events.join(F.broadcast(stop), F.col("event_id") < F.col("stop"))  # one row
    return ahead.agg(F.max("event_id").alias("cursor_at"), F.count("*").alias("settled"))


@query(
    "week_periods",
    """
    select strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week, count(*) as n, count(*) filter (where dayofweek(o_orderdate) in (0, 6)) as weekend from orders group by 1
    """,
)
def week_periods(spark, sf_dir):
    """Weeks that start on Monday."""
    week = F.date_format(F.date_trunc("week", "o_orderdate"), "yyyy-MM-dd").alias("week")
    return table(spark, sf_dir, "orders").groupBy(week).agg(F.count("*").alias("n"), F.count_if(F.dayofweek("o_orderdate").isin(1, 7)).alias("weekend"))


@query(
    "timing_summary",
    """
    with c as (select user_id, max(epoch(ts)) - min(epoch(ts)) as took from events group by 1)
    select round(median(took), 3) as median_took, round(max(took), 3) as longest, round(avg(case when took <= 2500000 then 1.0 else 0.0 end), 9) as in_time, count(*) as n from c
    """,
)
def timing_summary(spark, sf_dir):
    cycles = table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(seconds()) - F.min(seconds())).alias("took"))
    return cycles.agg(
        F.round(F.median("took"), 3).alias("median_took"), F.round(F.max("took"), 3).alias("longest"),
        F.round(F.avg((F.col("took") <= 2500000).cast("double")), 9).alias("in_time"), F.count("*").alias("n"),
    )


@query(
    "retention",
    "select event_type, count(*) as kept from events where ts >= (select max(ts) from events) - interval 10 day group by 1",
)
def retention(spark, sf_dir):
    """Rows younger than the retention period, counted from the newest."""
    events = table(spark, sf_dir, "events")
    newest = events.agg((F.max("ts") - F.expr("interval 10 days")).alias("cutoff"))
    return events.join(F.broadcast(newest), F.col("ts") >= F.col("cutoff")).groupBy("event_type").agg(F.count("*").alias("kept"))  # one row
