"""Snapshots, failure runs, keyed state machines as ordered folds, and windows over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.operators.health import account_states, health_states, pacing
from sigloom.plans.base import query, table

_LATEST = "with r as (select *, row_number() over (partition by conv_id order by turn desc) as place from conversations)"


@query(f"{_LATEST} select conv_id, turn, sha256(text) as hash from r where place = 1")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version of each monitor: an aggregate, so hot monitors shrink before the shuffle."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("hash"))
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("hash", "turn").alias("hash"))


@query(f"{_LATEST} select conv_id, turn, place::int as place from r where place <= 3")
def keep_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest three versions of each monitor."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", place.alias("place")).where("place <= 3")


@query("select conv_id, turn, sha256(text) <> coalesce(lag(sha256(text)) over (partition by conv_id order by turn), '') as changed from conversations")
def hash_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which versions differ from the one before."""
    hashed = F.sha2("text", 256)
    before = F.coalesce(F.lag("h").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hashed.alias("h")).select("conv_id", "turn", (F.col("h") != before).alias("changed"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn)::int as step from conversations")
def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", step.alias("step"))


@query("""with e as (select user_id, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as i from events),
g as (select user_id, i - row_number() over (partition by user_id order by i) as island from e where bad), r as (select user_id, count(*) as n from g group by user_id, island)
select user_id, max(n) as longest, count(*) as runs from r group by 1""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of failures of each source, and the number of runs."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_type") == "error").alias("bad"), F.row_number().over(order).alias("i"))
    islands = rows.where("bad").select("user_id", (F.col("i") - F.row_number().over(Window.partitionBy("user_id").orderBy("i"))).alias("island"))
    runs = islands.groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.count("*").alias("runs"))


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n, round(sum(value), 2) as total from events group by 1, 2")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""with s as (select event_type, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start from events)
select event_type, start, count(*) as n from s group by 1, 2""")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each hour that begins every half hour."""
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n")


@query("""with g as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, event_id) as k from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that six quiet hours end."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n"))
    return rows.select("user_id", "start", "n")


@query()
def health_final_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures, state, back-off and mean latency of each source after all its fetches."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"))
    return health_states(rows)


@query()
def account_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget and circuit of each account after all its calls."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.col("ts").alias("at"), "event_id", (F.col("event_type") != "error").alias("ok"))
    return account_states(rows)


@query()
def host_pacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each host's calls may go, one every five minutes; calls that would wait long are skipped."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("host"), F.col("user_id"), F.col("ts").alias("at"), "event_id")
    return pacing(rows.withColumn("host", F.concat_ws("-", "host", F.col("user_id").cast("string"))).drop("user_id"), 300, 1200)


@query("""with v as (select conv_id, turn, string_split(text, '. ') as lines, coalesce(lag(string_split(text, '. ')) over (partition by conv_id order by turn), []) as old from conversations)
select conv_id, turn, len(list_filter(lines, lambda x: not list_contains(old, x)))::int as added, len(list_filter(old, lambda x: not list_contains(lines, x)))::int as removed,
len(list_filter(lines, lambda x: not list_contains(old, x))) > 0 as accepted from v""")
def diff_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a version adds and drops; pure deletions aren't news."""
    lines = F.split("text", r"\. ", -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", lines.alias("lines"))
    old = F.coalesce(F.lag("lines").over(Window.partitionBy("conv_id").orderBy("turn")), F.expr("cast(array() as array<string>)"))
    rows = rows.withColumn("old", old)
    added = F.filter("lines", lambda x: ~F.array_contains(F.col("old"), x))
    removed = F.filter("old", lambda x: ~F.array_contains(F.col("lines"), x))
    return rows.select("conv_id", "turn", F.size(added).alias("added"), F.size(removed).alias("removed"), (F.size(added) > 0).alias("accepted"))


@query("select user_id, count(*) filter (event_type = 'error') as failures, count(*) filter (event_type = 'error') >= 3 as parked from events group by 1")
def park_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that failed three times are parked."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"))
    return rows.select("user_id", "failures", (F.col("failures") >= 3).alias("parked"))


@query("with l as (select max(ts) as beat, arg_max(event_type, (ts, event_id)) as last from events) select case when last = 'error' then 'error' when last = 'signup' then 'starting' else 'running' end as status from l")
def scheduler_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.select(F.when(F.col("last") == "error", "error").when(F.col("last") == "signup", "starting").otherwise("running").alias("status"))
