"""Feeds, cards, catch-up views, reports and health counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.operators.threads import material, rank, resonance, rollup, worth_summary
from sigloom.plans.base import query, table
from sigloom.sources.bind import ARTICLES, MEMBERS, THREADS, USAGE, articles, members, threads, usage

W = f"with {THREADS}, "
AS_OF = "(select max(l_shipdate) from lineitem)"


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate").alias("as_of")))  # one row


@query(f"with {THREADS} select thread_id, members, publishers, lifecycle, first_seen, last_update from rolled")
def thread_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers, lifecycle and times of every thread."""
    return rollup(members(spark, sf_dir))


@query("""with b as (
  select event_type, time_bucket(interval '15 minutes', ts) as bucket, count(*) as members, count(distinct user_id) as publishers,
         greatest(epoch(max(ts) - min(ts)) / 3600.0, 0.5) as hours from events group by 1, 2)
select event_type, bucket, members, publishers, round(case when publishers <= 1 then 0 else publishers / hours end, 6) as resonance,
       case when publishers <= 1 then 0 else publishers / hours end >= 2 as resonant from b""")
def burst_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resonance of event types in quarters of an hour."""
    events = table(spark, sf_dir, "events").withColumn("bucket", F.window("ts", "15 minutes")["start"])
    hours = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9
    rolled = events.groupBy("event_type", "bucket").agg(F.count("*").alias("members"), F.countDistinct("user_id").alias("publishers"), hours.alias("hours"))
    score = resonance(F.col("publishers"), F.col("hours"))
    return rolled.select("event_type", "bucket", "members", "publishers", F.round(score, 6).alias("resonance"), (score >= 2).alias("resonant"))


@query(f"""{W} w as (select * from thread where last_update >= {AS_OF} - interval '168 hours')
select (select count(*) from documents)::bigint as ingested, (select count(*) from labels where toxic = 1)::bigint as gated, count(*)::bigint as threads,
       coalesce(sum(members - 1) filter (members > 1), 0)::bigint as merged, count(*) filter (resonant)::bigint as resonant,
       count(*) filter (summarised)::bigint as reports,
       ((select count(*) from labels where toxic = 1) + coalesce(sum(members - 1) filter (members > 1), 0))::bigint as noise_removed from w""")
def radar_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a week brought in, removed and merged."""
    all_ = threads(spark, sf_dir)
    week = all_.crossJoin(_as_of(spark, sf_dir)).where(F.col("last_update") >= F.col("as_of") - F.expr("interval 168 hours"))
    merged = F.coalesce(F.sum(F.when(F.col("members") > 1, F.col("members") - 1)), F.lit(0))
    rolled = week.agg(F.count("*").alias("threads"), merged.alias("merged"), F.count_if("resonant").alias("resonant"), F.count_if("summarised").alias("reports"))
    ingested = table(spark, sf_dir, "documents").agg(F.count("*").alias("ingested"))
    gated = table(spark, sf_dir, "labels").agg(F.count_if(F.col("toxic") == 1).alias("gated"))
    one = rolled.crossJoin(ingested).crossJoin(gated)  # a row each
    return one.select("ingested", "gated", "threads", "merged", "resonant", "reports", (F.col("gated") + F.col("merged")).alias("noise_removed"))


@query(f"{W} x as (select 1) select thread_id, target, section, lifecycle, summarised_at from thread where summarised order by summarised_at desc, thread_id desc limit 30")
def feed_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 threads summarised last."""
    rows = threads(spark, sf_dir).where("summarised").select("thread_id", "target", "section", "lifecycle", "summarised_at")
    return rows.orderBy(F.desc("summarised_at"), F.desc("thread_id")).limit(30)


_CARD = ["thread_id", "lifecycle", "publishers", "resonant", "last_update"]


@query(f"{W} x as (select 1) select {', '.join(_CARD)} from thread where summarised order by summarised_at desc, thread_id limit 50")
def thread_view_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(spark, sf_dir).where("summarised").orderBy(F.desc("summarised_at"), "thread_id").limit(50).select(*_CARD)


@query(f"{W} x as (select 1) select {', '.join(_CARD)} from thread where not summarised order by publishers desc, last_update desc, thread_id limit 50")
def thread_view_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(spark, sf_dir).where("not summarised").orderBy(F.desc("publishers"), F.desc("last_update"), "thread_id").limit(50).select(*_CARD)


@query(f"{W} x as (select 1) select {', '.join(_CARD)} from thread order by resonant desc, last_update desc, thread_id limit 50")
def thread_view_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(spark, sf_dir).orderBy(F.desc("resonant"), F.desc("last_update"), "thread_id").limit(50).select(*_CARD)


@query(f"with {MEMBERS} select thread_id, arg_min(publisher, (no, publisher)) as publisher, min(no) as no from member group by 1")
def lead_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first member of each thread."""
    return members(spark, sf_dir).groupBy("thread_id").agg(F.min_by("publisher", F.struct("no", "publisher")).alias("publisher"), F.min("no").alias("no"))


@query(f"""{W} w as (select *, count(*) over () as n, sum(resonant::int) over () as n_resonant, sum((lifecycle = 'CONFIRMED')::int) over () as n_confirmed
  from thread where last_update >= {AS_OF} - interval '14 days')
select thread_id, lifecycle, publishers, resonant, n, n_resonant::bigint as n_resonant, n_confirmed::bigint as n_confirmed,
       case when lifecycle = 'CONFIRMED' and resonant then 'confirmed,resonant' when lifecycle = 'CONFIRMED' then 'confirmed' when resonant then 'resonant' else '' end as reasons from w""")
def catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the last fortnight with why they alert, and the counts of all of them."""
    all_ = threads(spark, sf_dir)
    rows = all_.crossJoin(_as_of(spark, sf_dir)).where(F.col("last_update") >= F.col("as_of") - F.expr("interval 14 days"))
    totals = rows.agg(F.count("*").alias("n"), F.count_if("resonant").alias("n_resonant"), F.count_if(F.col("lifecycle") == "CONFIRMED").alias("n_confirmed"))
    reasons = F.concat_ws(",", F.when(F.col("lifecycle") == "CONFIRMED", "confirmed"), F.when(F.col("resonant"), "resonant"))
    return rows.crossJoin(F.broadcast(totals)).select("thread_id", "lifecycle", "publishers", "resonant", "n", "n_resonant", "n_confirmed", reasons.alias("reasons"))


@query(f"""{W} w as (select *, case when lifecycle = 'CONFIRMED' and resonant then 0 when lifecycle = 'CONFIRMED' then 1 else 2 end as reason
  from thread where first_seen >= {AS_OF} - interval '60 days' and (resonant or lifecycle = 'CONFIRMED') and high_attention)
select thread_id, target, reason, publishers from w order by reason, publishers desc, thread_id limit 8""")
def away_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best new threads of targets that matter."""
    all_ = threads(spark, sf_dir)
    fresh = all_.crossJoin(_as_of(spark, sf_dir)).where((F.col("first_seen") >= F.col("as_of") - F.expr("interval 60 days")) & (F.col("resonant") | (F.col("lifecycle") == "CONFIRMED")) & F.col("high_attention"))
    reason = F.when((F.col("lifecycle") == "CONFIRMED") & F.col("resonant"), 0).when(F.col("lifecycle") == "CONFIRMED", 1).otherwise(2)
    return fresh.select("thread_id", "target", reason.alias("reason"), "publishers").orderBy("reason", F.desc("publishers"), "thread_id").limit(8)


@query("select distinct o_orderkey as thread_id from orders where o_custkey in (select c_custkey from customer where c_acctbal > 9000)")
def threads_of_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the targets with the highest attention: a semi-join."""
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("thread_id")).distinct()


@query(f"with {ARTICLES} select id, title, created_at from article where not exists (select 1 from embeddings where vec_id = id) order by created_at, id limit 100")
def pending_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest articles without a vector: an anti-join."""
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return articles(spark, sf_dir).join(known, "id", "left_anti").orderBy("created_at", "id").limit(100).select("id", "title", "created_at")


@query("""with u as (select conv_id, count(*) as n_updates, max(turn) as last_turn from conversations group by 1)
select conv_id, n_updates, last_turn, url from u join pages on page_id = conv_id""")
def updates_with_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of each page monitor with its page."""
    updates = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_updates"), F.max("turn").alias("last_turn"))
    return updates.join(table(spark, sf_dir, "pages").select(F.col("page_id").alias("conv_id"), "url"), "conv_id")


@query(f"""with {USAGE} select coalesce(model, 'ALL') as model, coalesce(action, 'ALL') as action, count(*) as calls, sum(tokens)::bigint as tokens
from usage group by grouping sets ((model), (action), (model, action), ())""")
def usage_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by model, by action, by both and in all."""
    usage(spark, sf_dir).createOrReplaceTempView("sigloom_usage")
    return spark.sql("select coalesce(model, 'ALL') as model, coalesce(action, 'ALL') as action, count(*) as calls, sum(tokens) as tokens from sigloom_usage group by grouping sets ((model), (action), (model, action), ())")


@query(f"""with {USAGE}, days as (select unnest(generate_series(min("at")::date, max("at")::date, interval 1 day))::date as day from usage),
d as (select "at"::date as day, count(*) as calls, sum(tokens)::bigint as tokens from usage where action = 'purchase' group by 1)
select strftime(day, '%Y-%m-%d') as day, coalesce(calls, 0) as calls, coalesce(tokens, 0) as tokens from days left join d using (day)""")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of each day, days without any included."""
    rows = usage(spark, sf_dir)
    days = rows.agg(F.min(F.to_date("at")).alias("lo"), F.max(F.to_date("at")).alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("day"))
    found = rows.where("action = 'purchase'").groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return days.join(found, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


#: Dollars for a million tokens, by the first part of a name that fits.
PRICES = [("text-embedding", 0.15), ("embedding", 0.15), ("flash", 1.50), ("pro", 1.25)]
DEFAULT_PRICE = 1.50


@query(f"with {USAGE} select model, sum(tokens)::bigint as tokens, round(sum(tokens) / 1e6 * case when model like '%text-embedding%' then 0.15 when model like '%embedding%' then 0.15 when model like '%flash%' then 1.5 when model like '%pro%' then 1.25 else 1.5 end, 6)::double as usd from usage group by 1")
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.lit(DEFAULT_PRICE)
    for part, dollars in reversed(PRICES):
        price = F.when(F.col("model").contains(part), dollars).otherwise(price)
    rolled = usage(spark, sf_dir).groupBy("model").agg(F.sum("tokens").alias("tokens"))
    return rolled.select("model", "tokens", F.round(F.col("tokens") / 1e6 * price, 6).alias("usd"))


_SPIKES = f"""{W} recent as (select thread_id from thread where summarised and last_update >= {AS_OF} - interval '900 days'),
e as (select upper(trim(p_brand)) as entity, thread_id from member join recent using (thread_id) join part on p_partkey = entity_id)
select entity, count(distinct thread_id) as threads from e group by 1 having count(distinct thread_id) >= %d order by threads desc, entity limit %d"""


def _spikes(spark: SparkSession, sf_dir: str, least: int, limit: int) -> DataFrame:
    all_ = threads(spark, sf_dir)
    recent = all_.crossJoin(_as_of(spark, sf_dir)).where(F.col("summarised") & (F.col("last_update") >= F.col("as_of") - F.expr("interval 900 days"))).select("thread_id")
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.upper(F.trim("p_brand")).alias("entity"))
    rows = members(spark, sf_dir).join(recent, "thread_id").join(names, "entity_id")
    return rows.groupBy("entity").agg(F.countDistinct("thread_id").alias("threads")).where(F.col("threads") >= least).orderBy(F.desc("threads"), "entity").limit(limit)


@query(_SPIKES % (3, 3))
def entity_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities named by three recent threads at least: the top three."""
    return _spikes(spark, sf_dir, 3, 3)


@query(_SPIKES % (2, 50))
def trend_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from two threads."""
    return _spikes(spark, sf_dir, 2, 50)


@query("""select count(*) filter (v.vec_id is null) as unembedded, count(*) filter (v.vec_id is not null and coalesce(l.toxic, 0) = 0 and d.doc_id % 3 = 0) as unthreaded
from documents d left join embeddings v on v.vec_id = d.doc_id left join labels l on l.doc_id = d.doc_id""")
def pipeline_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that wait for a vector, and articles with one that wait for a thread."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded"))
    joined = docs.join(vectors, "doc_id", "left").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    waits = F.col("embedded") & (F.coalesce("toxic", F.lit(0)) == 0) & (F.col("doc_id") % 3 == 0)
    return joined.agg(F.count_if(F.col("embedded").isNull()).alias("unembedded"), F.count_if(waits).alias("unthreaded"))


@query(f"""with {USAGE}, last as (select max("at")::date as day from usage), s as (select action, sum(tokens)::bigint as spent from usage, last where "at"::date = day group by 1)
select action, spent, spent < 20000 as allowed from s""")
def budget_brake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that each action spent on the last day, and whether it may go on."""
    rows = usage(spark, sf_dir)
    last = F.broadcast(rows.agg(F.max(F.to_date("at")).alias("day")))
    spent = rows.join(last, F.to_date("at") == F.col("day")).groupBy("action").agg(F.sum("tokens").alias("spent"))
    return spent.select("action", "spent", (F.col("spent") < 20000).alias("allowed"))


@query(f"""with {USAGE}, d as (select "at"::date as day, sum(tokens)::bigint as tokens from usage group by 1),
s as (select list_sort(list(tokens)) as v from d where tokens > 0), c as (select [v[least(len(v), floor(q * len(v))::bigint + 1)] for q in [0.25, 0.5, 0.75]] as cuts from s)
select strftime(day, '%Y-%m-%d') as day, tokens, len(list_filter(cuts, lambda x: x < tokens))::int as level from d, c""")
def heatmap_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in levels by the quartiles of the days with tokens; the days are few whatever the events."""
    days = usage(spark, sf_dir).groupBy(F.to_date("at").alias("day")).agg(F.sum("tokens").alias("tokens"))
    sorted_ = F.sort_array(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens"))))
    cuts = days.agg(sorted_.alias("v")).select(F.transform(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), lambda q: F.get("v", F.least(F.size("v") - 1, F.floor(q * F.size("v"))).cast("int"))).alias("cuts"))
    level = F.size(F.filter("cuts", lambda c: c < F.col("tokens")))
    return days.crossJoin(F.broadcast(cuts)).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "tokens", level.alias("level"))


@query(f"with {MEMBERS} select thread_id, bool_or(publisher % 7 = 0) as any_account, bool_and(tier = 'aggregated') as all_aggregated from member group by 1")
def lead_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether any member comes from a named account, and whether all are aggregated."""
    return members(spark, sf_dir).groupBy("thread_id").agg(F.bool_or(F.col("publisher") % 7 == 0).alias("any_account"), F.bool_and(F.col("tier") == "aggregated").alias("all_aggregated"))


@query(f"""{W} lines as (select target_id as storyline_id, count(*) as threads, sum(members)::bigint as members, arg_max(thread_id, (members, thread_id)) as biggest,
  min(first_seen) as first_seen, max(last_update) as last_update, bool_or(summarised) as any_refined from thread group by 1),
pubs as (select target_id as storyline_id, count(distinct publisher) as publishers from member join thread using (thread_id) group by 1)
select * from lines join pubs using (storyline_id)""")
def storyline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of a storyline in one row: its biggest thread, counts, publishers over all members, times."""
    all_ = threads(spark, sf_dir).withColumnRenamed("target_id", "storyline_id")
    lines = all_.groupBy("storyline_id").agg(
        F.count("*").alias("threads"), F.sum("members").alias("members"), F.max_by("thread_id", F.struct("members", "thread_id")).alias("biggest"),
        F.min("first_seen").alias("first_seen"), F.max("last_update").alias("last_update"), F.bool_or("summarised").alias("any_refined"),
    )
    pubs = members(spark, sf_dir).join(all_.select("thread_id", "storyline_id"), "thread_id").groupBy("storyline_id").agg(F.countDistinct("publisher").alias("publishers"))
    return lines.join(pubs, "storyline_id")


@query("select (select count(*) from documents) as articles, (select count(*) from orders) as threads, (select count(*) from customer) as targets, (select count(*) from customer where c_acctbal > 5000) as watched, (select count(*) from events where event_type = 'error') as errors")
def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda name, where="true": table(spark, sf_dir, name).where(where).agg(F.count("*"))
    one = n("documents").toDF("articles").crossJoin(n("orders").toDF("threads")).crossJoin(n("customer").toDF("targets"))
    return one.crossJoin(n("customer", "c_acctbal > 5000").toDF("watched")).crossJoin(n("events", "event_type = 'error'").toDF("errors"))


@query("select 'documents' as name, count(*) as n from documents union all select 'orders', count(*) from orders union all select 'events', count(*) from events union all select 'labels', count(*) from labels")
def db_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the tables."""
    parts = [table(spark, sf_dir, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in ("documents", "orders", "events", "labels")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"with {MEMBERS} select thread_id, substr(string_agg(distinct 'src' || publisher, ', ' order by 'src' || publisher), 1, 80) as sources from member group by 1")
def source_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sources of a thread as text, cut at 80 characters."""
    names = F.sort_array(F.collect_set(F.concat(F.lit("src"), F.col("publisher").cast("string"))))
    return members(spark, sf_dir).groupBy("thread_id").agg(F.substring(F.array_join(names, ", "), 1, 80).alias("sources"))


@query(f"with {USAGE} select coalesce(sum(tokens) filter (model like '%flash%'), 0)::bigint as flash, coalesce(sum(tokens) filter (model like '%pro%'), 0)::bigint as pro, sum(tokens)::bigint as total from usage")
def flash_pro_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda x: F.coalesce(F.sum(F.when(F.col("model").contains(x), F.col("tokens"))), F.lit(0))
    return usage(spark, sf_dir).agg(part("flash").alias("flash"), part("pro").alias("pro"), F.sum("tokens").alias("total"))


@query("""with h as (select user_id, count(*) as used, count(*) filter (event_type = 'error') as failed from events group by 1)
select user_id, used, (used * 100 // 120) / 100 as utilization, used < 60 as under_used, failed * 4 >= used as stale_yield from h""")
def account_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use of each account against its daily budget of 120."""
    rolled = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("used"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return rolled.select("user_id", "used", (F.floor(F.col("used") * 100 / 120) / 100).alias("utilization"), (F.col("used") < 60).alias("under_used"), (F.col("failed") * 4 >= F.col("used")).alias("stale_yield"))


@query("""select event_type as route, count(*) as tried, round(avg((value > 10)::int), 2)::double as quality, arg_min(event_id, (case when event_type = 'error' then 1 else 0 end, ts, event_id)) as first_ok
from events group by 1""")
def route_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of useful items of each route, and the first that came well."""
    first = F.min_by("event_id", F.struct(F.when(F.col("event_type") == "error", 1).otherwise(0), "ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("route")).agg(F.count("*").alias("tried"), F.round(F.avg((F.col("value") > 10).cast("int")), 2).alias("quality"), first.alias("first_ok"))


@query(f"with {ARTICLES} select id, title, publisher, created_at from article order by created_at desc, id desc limit 50")
def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).orderBy(F.desc("created_at"), F.desc("id")).limit(50).select("id", "title", "publisher", "created_at")


@query(f"{W} x as (select 1) select thread_id, resonant, lifecycle from thread order by resonant desc, case lifecycle when 'CONFIRMED' then 4 when 'CORROBORATED' then 3 else 2 end desc, last_update desc, thread_id limit 40")
def site_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public site's order: resonant, important, recent."""
    rows = threads(spark, sf_dir).orderBy(F.desc("resonant"), F.desc(rank(F.col("lifecycle"))), F.desc("last_update"), "thread_id")
    return rows.limit(40).select("thread_id", "resonant", "lifecycle")


@query(f"""{W} t as (select c_custkey as target_id from customer), ranked as (select thread_id, target_id, row_number() over (partition by target_id order by last_update desc, thread_id) as place from thread)
select target_id, thread_id, place::int as place from ranked where place <= 6""")
def storyline_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six latest threads of each storyline."""
    place = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("last_update"), "thread_id"))
    return threads(spark, sf_dir).select("target_id", "thread_id", place.alias("place")).where("place <= 6")


@query(f"""with {MEMBERS}, r as (select thread_id, no, publisher, row_number() over (partition by thread_id order by (tier = 'primary') desc, "at" desc, no, publisher, entity_id) as place from member)
select thread_id, no, publisher, place::int as place from r where place <= 8""")
def card_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a card: the cited first, then the latest, eight at most."""
    order = Window.partitionBy("thread_id").orderBy(F.desc(F.col("tier") == "primary"), F.desc("at"), "no", "publisher", "entity_id")
    return members(spark, sf_dir).withColumn("place", F.row_number().over(order)).where("place <= 8").select("thread_id", "no", "publisher", "place")


@query(f"""{W} a as (select {AS_OF} as t) select thread_id, case when last_update::date = t::date then 'today' when last_update >= t - interval '7 days' then 'week' else 'older' end as bucket,
least(epoch(t - last_update) // 3600, 9999)::bigint as hours from thread, a""")
def recency_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today, this week or older, and the hours since."""
    all_ = threads(spark, sf_dir)
    bucket = F.when(F.to_date("last_update") == F.to_date("as_of"), "today").when(F.col("last_update") >= F.col("as_of") - F.expr("interval 7 days"), "week").otherwise("older")
    hours = F.expr("least(timestampdiff(second, last_update, as_of) div 3600, 9999)")
    return all_.crossJoin(_as_of(spark, sf_dir)).select("thread_id", bucket.alias("bucket"), hours.cast("bigint").alias("hours"))


@query("select conv_id, string_agg(role, '>' order by turn) as steps, count(*) as n from conversations group by 1")
def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of a run in order."""
    steps = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(steps, lambda s: s["role"]), ">").alias("steps"), F.count("*").alias("n"))


@query("select event_id, event_type from events order by ts desc, event_id desc limit 50")
def last_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 status rows."""
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query(f"""{W} top as (select thread_id, target, lifecycle, publishers from thread where summarised and section = 'BUILDING' order by summarised_at desc, thread_id limit 20)
select thread_id, '{{"thread_id":' || thread_id || ',"target":"' || target || '","lifecycle":"' || lifecycle || '","publishers":' || publishers || '}}' as line from top""")
def cli_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty threads of a section as lines of JSON."""
    rows = threads(spark, sf_dir).where("summarised and section = 'BUILDING'").orderBy(F.desc("summarised_at"), "thread_id").limit(20)
    return rows.select("thread_id", F.to_json(F.struct("thread_id", "target", "lifecycle", "publishers")).alias("line"))


@query(f"""{W} f as (select thread_id, bool_or(tier = 'primary') as p, bool_or(publisher % 7 = 0) as a from member group by 1)
select thread_id, case when p then 'primary' when a then 'account' when lifecycle = 'CONFIRMED' then 'confirmed' when high_attention then 'attention' when resonant then 'resonant' when publishers >= 3 then 'publishers' else 'none' end as reason
from thread join f using (thread_id)""")
def worth_summary_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each thread earns a summary."""
    flags = members(spark, sf_dir).groupBy("thread_id").agg(F.bool_or(F.col("tier") == "primary").alias("p"), F.bool_or(F.col("publisher") % 7 == 0).alias("a"))
    reason = worth_summary(F.col("p"), F.col("a"), F.col("lifecycle"), F.col("high_attention"), F.col("resonant"), F.col("publishers"))
    return threads(spark, sf_dir).join(flags, "thread_id").select("thread_id", reason.alias("reason"))


@query(f"""{W} s as (select thread_id, case when thread_id % 5 = 0 then null else thread_id % 4 end as before, thread_id % 3 as before_rank from thread),
r as (select t.thread_id, before, before_rank, publishers - coalesce(before, 0) as growth, case lifecycle when 'CONFIRMED' then 2 when 'CORROBORATED' then 1 else 0 end as now from thread t join s using (thread_id))
select thread_id, now > before_rank or (growth > 0 and (coalesce(before, 0) <= 0 or growth / before >= 0.25)) as is_material from r""")
def material_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which threads have grown enough for another summary."""
    before = F.when(F.col("thread_id") % 5 != 0, F.col("thread_id") % 4)
    found = material(F.col("thread_id") % 3, rank(F.col("lifecycle")), before, F.col("publishers"))
    return threads(spark, sf_dir).select("thread_id", found.alias("is_material"))


@query(f"""with {MEMBERS}, o as (select thread_id, no, publisher, min(no) over (partition by thread_id, publisher) as first_no from (select thread_id, publisher, row_number() over (partition by thread_id order by "at", no, publisher) as no from member)),
r as (select thread_id, no, sum((no = first_no)::int) over (partition by thread_id order by no) as sources from o)
select thread_id, max(sources)::int as sources, max(no)::int as steps from r group by 1""")
def running_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct publishers as members arrive: the count at the end of the replay and its length.  The count never falls,
    so its end is the number of publishers whatever the order of arrival, and no thread is put in order."""
    by_publisher = members(spark, sf_dir).groupBy("thread_id", "publisher").agg(F.count("*").alias("n"))
    return by_publisher.groupBy("thread_id").agg(F.count("*").cast("int").alias("sources"), F.sum("n").cast("int").alias("steps"))


def _levels(most: int = 2**40) -> list[int]:
    """The counts of publishers at which a thread that gains them one by one has materially grown: each a quarter more
    than the one before.  A fixed, short list, whatever the data."""
    found = [1]
    while found[-1] < most:
        found.append(max(found[-1] + 1, -(-5 * found[-1] // 4)))
    return found


@query(f"""with recursive {MEMBERS}, f as (select thread_id, publisher, min(struct_pack(a := "at", n := no)) as first from member group by 1, 2),
r as (select thread_id, first.a as "at", row_number() over (partition by thread_id order by first, publisher) as n from f),
level(n) as (select 1::bigint union all select greatest(n + 1, ceil(n * 1.25))::bigint from level where n <= (select max(n) from r))
select thread_id, max(r.n)::int as baseline, arg_max("at", r.n) as last_material from r join level using (n) group by 1""")
def material_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays each thread in order of arrival: the baseline moves only when growth is material.  Only a publisher's first
    arrival can move it, so members are reduced to those before any thread is put in order."""
    first = members(spark, sf_dir).groupBy("thread_id", "publisher").agg(F.min(F.struct("at", "no")).alias("first"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("thread_id").orderBy("first", "publisher")))
    moved = ranked.where(F.col("n").isin(*_levels()))
    return moved.groupBy("thread_id").agg(F.max("n").alias("baseline"), F.max_by("first.at", "n").alias("last_material"))


_FACT = "case when lifecycle = 'CONFIRMED' then 'confirmed' when lifecycle = 'CORROBORATED' or publishers >= 2 then 'corroborated' else 'lead' end"


@query(f"{W} x as (select 1) select thread_id, {_FACT} as fact_level, case lifecycle when 'CONFIRMED' then 4 when 'CORROBORATED' then 3 else 2 end as importance from thread")
def fact_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure a thread is, and how important."""
    level = F.when(F.col("lifecycle") == "CONFIRMED", "confirmed").when((F.col("lifecycle") == "CORROBORATED") | (F.col("publishers") >= 2), "corroborated").otherwise("lead")
    return threads(spark, sf_dir).select("thread_id", level.alias("fact_level"), (rank(F.col("lifecycle")) + 2).alias("importance"))


@query(f"""{W} top as (select *, 'thr_' || substr(sha256('local:' || thread_id), 1, 8) as public_id from thread where summarised order by resonant desc, last_update desc, thread_id limit 200)
select public_id, thread_id, {_FACT} as fact_level, strftime(last_update, '%Y-%m-%dT%H:%M:%SZ') as updated from top""")
def digest_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published digest's threads under public ids."""
    rows = threads(spark, sf_dir).where("summarised").orderBy(F.desc("resonant"), F.desc("last_update"), "thread_id").limit(200)
    level = F.when(F.col("lifecycle") == "CONFIRMED", "confirmed").when((F.col("lifecycle") == "CORROBORATED") | (F.col("publishers") >= 2), "corroborated").otherwise("lead")
    public = F.concat(F.lit("thr_"), F.substring(F.sha2(F.concat(F.lit("local:"), F.col("thread_id").cast("string")), 256), 1, 8))
    return rows.select(public.alias("public_id"), "thread_id", level.alias("fact_level"), F.date_format("last_update", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"))


@query("""with r as (select o_orderkey, o_orderdate, row_number() over (order by o_orderdate, o_orderkey) as place, count(*) over () as n, max(o_orderdate) over () as t from orders)
select o_orderkey as thread_id, case when o_orderdate < t - interval '1000 days' then 'aged' when place <= floor(n * 0.25) then 'oldest' else 'kept' end as fate from r""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What age and size retention take: the oldest quarter goes by an exact cut of the order dates, found by a
    distributed sort of counts by date, so no task holds all rows."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("thread_id"), F.col("o_orderdate").alias("at"))
    by_day = orders.groupBy("at").agg(F.count("*").alias("n"))  # as many rows as there are dates
    running = by_day.select("at", "n", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("before"))
    total = orders.agg(F.count("*").alias("total"), F.max("at").alias("t"))
    within = F.row_number().over(Window.partitionBy("at").orderBy("thread_id"))
    rows = orders.withColumn("within", within).join(running.select("at", "before"), "at").crossJoin(F.broadcast(total))
    fate = F.when(F.col("at") < F.col("t") - F.expr("interval 1000 days"), "aged").when(F.col("before") + F.col("within") <= F.floor(F.col("total") * 0.25), "oldest").otherwise("kept")
    return rows.select("thread_id", fate.alias("fate"))
