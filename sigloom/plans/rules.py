"""Single-rule flags, route tables, guards and maintenance moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.plans.base import query, table
from sigloom.sources.bind import ARTICLES, MEMBERS, THREADS, articles, members, threads

W = f"with {THREADS}, x as (select 1)"
AS_OF = "(select max(ts) from events)"


@query(f"select user_id, max(ts) as last_run, max(ts) + interval '30 minutes' <= {AS_OF} as due from events group by 1")
def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets whose interval of 30 minutes has passed."""
    events = table(spark, sf_dir, "events")
    now = F.broadcast(events.agg(F.max("ts").alias("now")))  # one row
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_run"))
    return last.crossJoin(now).select("user_id", "last_run", (F.col("last_run") + F.expr("interval 30 minutes") <= F.col("now")).alias("due"))


@query("select page_id, contains(lower(url), '/login') or regexp_matches(lower(html), 'sign in|log in to continue|password') as wall from pages")
def login_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that ask for a login, by address or by text."""
    wall = F.lower("url").contains("/login") | F.lower("html").rlike("sign in|log in to continue|password")
    return table(spark, sf_dir, "pages").select("page_id", wall.alias("wall"))


@query(f"with {MEMBERS}, bad as (select distinct thread_id from member where publisher % 11 = 0) select distinct thread_id from member where thread_id not in (select thread_id from bad)")
def auth_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads without a member from a platform behind a login: an anti-join."""
    rows = members(spark, sf_dir)
    bad = rows.where("publisher % 11 = 0").select("thread_id").distinct()
    return rows.select("thread_id").distinct().join(bad, "thread_id", "left_anti")


@query(f"""{W}, f as (select thread_id, bool_and(tier = 'aggregated') as only_aggregated, bool_or(publisher % 7 = 0) as account from member group by 1)
select thread_id, lifecycle = 'CONFIRMED' or resonant as focus, not account and only_aggregated and publishers <= 1 as collapsible, section = 'MACHINERY' as folded from thread join f using (thread_id)""")
def focus_fold_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader's screen shows first, collapses or folds."""
    flags = members(spark, sf_dir).groupBy("thread_id").agg(F.bool_and(F.col("tier") == "aggregated").alias("only"), F.bool_or(F.col("publisher") % 7 == 0).alias("account"))
    rows = threads(spark, sf_dir).join(flags, "thread_id")
    return rows.select("thread_id", ((F.col("lifecycle") == "CONFIRMED") | F.col("resonant")).alias("focus"), (~F.col("account") & F.col("only") & (F.col("publishers") <= 1)).alias("collapsible"), (F.col("section") == "MACHINERY").alias("folded"))


@query("select page_id, regexp_matches(url, '(?i)^https?://') as safe from pages")
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("url").rlike("(?i)^https?://").alias("safe"))


@query(f"with {MEMBERS} select thread_id, not bool_or(tier in ('primary', 'curated')) as rumor, count(distinct publisher) >= 2 as can_synthesise from member group by 1")
def rumor_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of aggregated members only, and threads with enough publishers to synthesise."""
    return members(spark, sf_dir).groupBy("thread_id").agg((~F.bool_or(F.col("tier").isin("primary", "curated"))).alias("rumor"), (F.countDistinct("publisher") >= 2).alias("can_synthesise"))


@query(f"with {ARTICLES}, t as (select *, row_number() over (partition by lower(title) order by id) as place from article where title <> '') select id, title from t where place = 1")
def dedup_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each title: an aggregate, so a hot title shrinks before the shuffle."""
    rows = articles(spark, sf_dir).where("title <> ''").groupBy(F.lower("title").alias("key")).agg(F.min(F.struct("id", "title")).alias("first"))
    return rows.select("first.id", "first.title")


@query(f"{W} select thread_id, case when lifecycle = 'CONFIRMED' then 'confirmed' else 'resonant' end as reason from thread where (lifecycle = 'CONFIRMED' or resonant) and thread_id % 4 <> 0")
def alert_idempotence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts not given before: the known ones (every fourth thread) are taken out by an anti-join."""
    new = threads(spark, sf_dir).where("lifecycle = 'CONFIRMED' or resonant").select("thread_id", F.when(F.col("lifecycle") == "CONFIRMED", "confirmed").otherwise("resonant").alias("reason"))
    known = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("thread_id"))
    return new.join(known, "thread_id", "left_anti")


@query(f"""{W} select thread_id, members, (to_json({{'id': thread_id, 'target': target}}))::varchar as card from thread where not exists (select 1 from labels where doc_id = thread_id and toxic = 1) and summarised""")
def thread_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of summarised threads that no label rejects."""
    rejected = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("thread_id"))
    rows = threads(spark, sf_dir).where("summarised").join(rejected, "thread_id", "left_anti")
    return rows.select("thread_id", "members", F.to_json(F.struct(F.col("thread_id").alias("id"), "target")).alias("card"))


@query(f"{W} select thread_id from thread where not exists (select 1 from orders where o_orderkey = thread_id and o_orderkey % 5 = 0) order by last_update desc, thread_id desc limit 300")
def background_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 300 threads without a relation."""
    related = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("thread_id"))
    return threads(spark, sf_dir).join(related, "thread_id", "left_anti").orderBy(F.desc("last_update"), F.desc("thread_id")).limit(300).select("thread_id")


_STRATEGY = "case when page_id % 4 = 0 then 'agentic' when page_id % 4 = 1 then 'no_fallback' else 'rss_first' end"


@query(f"""with p as (select page_id, url, {_STRATEGY} as strategy from pages),
r as (select page_id, strategy, unnest(case strategy when 'agentic' then ['agentic'] when 'no_fallback' then ['rss'] else ['rss', 'agentic'] end) as adapter from p) select page_id, strategy, adapter from r""")
def url_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes of a URL by its strategy: a feed, a browser, or one after the other."""
    strategy = F.when(F.col("page_id") % 4 == 0, "agentic").when(F.col("page_id") % 4 == 1, "no_fallback").otherwise("rss_first")
    adapters = F.when(F.col("strategy") == "agentic", F.array(F.lit("agentic"))).when(F.col("strategy") == "no_fallback", F.array(F.lit("rss"))).otherwise(F.array(F.lit("rss"), F.lit("agentic")))
    return table(spark, sf_dir, "pages").select("page_id", strategy.alias("strategy")).select("page_id", "strategy", F.explode(adapters).alias("adapter"))


@query("""with r as (select p_partkey, p_brand as anchor, p_size as version, length(p_name) as n from part), k as (select *, row_number() over (partition by anchor order by version desc, n desc, p_partkey) as place from r)
select anchor, p_partkey, place::int as place from k where place <= 8""")
def alias_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight alias routes of each anchor, by version and then length."""
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("version"), F.desc("n"), "p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("anchor"), F.col("p_size").alias("version"), F.length("p_name").alias("n"))
    return rows.select("anchor", "p_partkey", place.alias("place")).where("place <= 8")


@query("""select c_custkey, case when c_mktsegment like 'A%' then 'ja' when c_mktsegment like 'B%' then 'ko' when c_mktsegment like 'M%' then 'zh' else 'en' end as edition,
case when c_acctbal > 0 then 20 else 10 end as cap from customer""")
def editions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target's edition, and its cap where the user's policy lies over the default one."""
    at = lambda x: F.col("c_mktsegment").startswith(x)
    policy = F.map_concat(F.map_filter(F.create_map(F.lit("cap"), F.lit(10), F.lit("max_days"), F.lit(7)), lambda k, v: ~((k == "cap") & (F.col("c_acctbal") > 0))), F.map_filter(F.create_map(F.lit("cap"), F.lit(20)), lambda k, v: F.col("c_acctbal") > 0))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(at("A"), "ja").when(at("B"), "ko").when(at("M"), "zh").otherwise("en").alias("edition"), F.element_at(policy, "cap").alias("cap"))


@query("""select s_suppkey, case when s_suppkey % 5 = 0 then 'twitter' when s_suppkey % 5 = 1 then 'weibo' else 'rss' end as platform, lower(trim(replace(s_name, '#', ''))) as handle,
case when s_acctbal < 0 then 'expired' when s_nationkey % 3 = 0 then 'missing' when s_nationkey % 3 = 1 then 'matched' else 'none' end as auth from supplier""")
def account_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with their platform, cleaned handle and login state."""
    by = F.col("s_suppkey") % 5
    auth = F.when(F.col("s_acctbal") < 0, "expired").when(F.col("s_nationkey") % 3 == 0, "missing").when(F.col("s_nationkey") % 3 == 1, "matched").otherwise("none")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(by == 0, "twitter").when(by == 1, "weibo").otherwise("rss").alias("platform"), F.lower(F.trim(F.replace("s_name", F.lit("#"), F.lit("")))).alias("handle"), auth.alias("auth"))


@query("""with i as (select n_regionkey as collection_id, n_nationkey as preset_id, n_name, row_number() over (partition by n_name order by n_regionkey, n_nationkey) as seen from nation)
select collection_id, preset_id, n_name as title, row_number() over (partition by collection_id order by preset_id)::int as place from i where seen = 1""")
def portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets of collections in their order, each the first time it occurs."""
    first = F.row_number().over(Window.partitionBy("n_name").orderBy("n_regionkey", "n_nationkey"))
    rows = table(spark, sf_dir, "nation").withColumn("seen", first).where("seen = 1")
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    return rows.select(F.col("n_regionkey").alias("collection_id"), F.col("n_nationkey").alias("preset_id"), F.col("n_name").alias("title"), place.alias("place"))


@query("""with t as (select event_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) as attempt, """ + AS_OF + """ as now from events)
select event_id, case when event_type = 'purchase' then 'DONE' when event_type = 'error' and attempt > 3 then 'FAILED' when now - ts > interval '30 minutes' then 'STALE' else 'RUNNING' end as state from t""")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of queued tasks: done, failed after three tries, stale after half an hour, or running."""
    events = table(spark, sf_dir, "events")
    attempt = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = events.select("event_id", "event_type", "ts", attempt.alias("attempt")).crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))
    state = F.when(F.col("event_type") == "purchase", "DONE").when((F.col("event_type") == "error") & (F.col("attempt") > 3), "FAILED").when(F.col("now") - F.col("ts") > F.expr("interval 30 minutes"), "STALE")
    return rows.select("event_id", state.otherwise("RUNNING").alias("state"))


@query("""with known as (select o_orderkey as thread_id, o_custkey as target_id from orders where o_orderkey % 2 = 0), fresh as (select distinct l_orderkey as thread_id, l_suppkey as target_id from lineitem)
select thread_id, target_id, 'old' as origin from known union all select f.thread_id, f.target_id, 'new' from fresh f where not exists (select 1 from known k where k.thread_id = f.thread_id and k.target_id = f.target_id)""")
def relation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with those added that weren't there."""
    known = table(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("thread_id"), F.col("o_custkey").alias("target_id"))
    fresh = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("thread_id"), F.col("l_suppkey").alias("target_id")).distinct()
    return known.withColumn("origin", F.lit("old")).union(fresh.join(known, ["thread_id", "target_id"], "left_anti").withColumn("origin", F.lit("new")))


@query("""with c as (select p_brand as value, count(*) as n from part group by 1) select value, n, case when n >= 90 then 'accepted' when n >= 70 then 'pending' else 'dismissed' end as status from c""")
def emergent_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of an emergent source."""
    counts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"))
    return counts.select("value", "n", F.when(F.col("n") >= 90, "accepted").when(F.col("n") >= 70, "pending").otherwise("dismissed").alias("status"))


@query("""with e as (select user_id, event_type in ('view', 'click') as empty, event_type = 'purchase' as good, row_number() over (partition by user_id order by ts, event_id) as i from events),
b as (select user_id, i, empty, max(case when not empty then i else 0 end) over (partition by user_id order by i) as last_full, max(case when good then i else 0 end) over (partition by user_id order by i) as last_good from e)
select user_id, max(case when empty and last_good > 0 then i - last_full else 0 end)::int as longest from b group by 1""")
def empty_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest run of empty answers of each source after it has once answered well."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").isin("view", "click").alias("empty"), (F.col("event_type") == "purchase").alias("good"), F.row_number().over(order).alias("i"))
    run = Window.partitionBy("user_id").orderBy("i")
    last = lambda c: F.max(F.when(c, F.col("i")).otherwise(0)).over(run)
    rows = rows.select("user_id", "i", "empty", last(~F.col("empty")).alias("full"), last(F.col("good")).alias("good_at"))
    return rows.groupBy("user_id").agg(F.max(F.when(F.col("empty") & (F.col("good_at") > 0), F.col("i") - F.col("full")).otherwise(0)).alias("longest"))


@query(f"""with {ARTICLES}, s as (select id, trim(regexp_extract(content, '^[^.]*\\.([^.]*)', 1)) as second from article) select id, substr(second, 1, 300) as snippet, length(second) >= 20 as usable from s""")
def lead_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence after the headline, cut at 300 characters."""
    second = F.trim(F.regexp_extract("content", r"^[^.]*\.([^.]*)", 1))
    return articles(spark, sf_dir).select("id", second.alias("s")).select("id", F.substring("s", 1, 300).alias("snippet"), (F.length("s") >= 20).alias("usable"))


#: Fixed value: names whose values are secrets, and the values.
SECRET_VALUE = r"(?i)(token|key|cookie|auth|password|secret|credential|pass|pwd|sign|signature)=[^\s&,;?'\"]+"


@query()
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages without queries, and secrets in them taken out."""
    marked = F.concat_ws(" ", F.col("url"), F.lit("token=abc123&x"))
    clean = F.regexp_replace(marked, SECRET_VALUE, "$1=[REDACTED]")
    return table(spark, sf_dir, "pages").select("page_id", clean.alias("clean"), T.desensitize_url(F.col("url")).alias("shown"))
