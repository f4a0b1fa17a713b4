"""Filters, look-ups, labels and small merges of the read side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.threads import rank
from sigloom.plans.base import query, table
from sigloom.sources.bind import MEMBERS, THREADS, members, threads


@query("select o_orderkey, o_totalprice from orders where o_totalprice between 1000 and 100000 and (o_orderstatus = 'F' or o_orderpriority is null)")
def filter_basics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal, range, null and either-or predicates, all of which reach the scan."""
    kept = F.col("o_totalprice").between(1000, 100000) & ((F.col("o_orderstatus") == "F") | F.col("o_orderpriority").isNull())
    return table(spark, sf_dir, "orders").where(kept).select("o_orderkey", "o_totalprice")


@query("select doc_id, greatest(1, length(coalesce(text, '')) // 4)::bigint as tokens from documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's tokens, guessed from its length; one at least."""
    n = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    return table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1).cast("bigint"), n).alias("tokens"))


@query("select o_orderkey as thread_id, 'thr_' || substr(sha256('local:' || o_orderkey), 1, 8) as public_id from orders")
def public_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id under which a thread is published."""
    digest = F.sha2(F.concat(F.lit("local:"), F.col("o_orderkey").cast("string")), 256)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("thread_id"), F.concat(F.lit("thr_"), F.substring(digest, 1, 8)).alias("public_id"))


@query("""select l_orderkey as thread_id, l_suppkey as target_id, count(*) as n from lineitem
where case l_linenumber % 3 when 0 then true when 1 then false end is distinct from false group by 1, 2""")
def kept_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that no verdict rejects; none at all keeps a relation."""
    verdict = F.when(F.col("l_linenumber") % 3 == 0, True).when(F.col("l_linenumber") % 3 == 1, False)
    kept = table(spark, sf_dir, "lineitem").where(~verdict.eqNullSafe(False))
    return kept.groupBy(F.col("l_orderkey").alias("thread_id"), F.col("l_suppkey").alias("target_id")).agg(F.count("*").alias("n"))


@query("select event_id, hour(ts) >= 22 or hour(ts) < 7 as quiet from events")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event falls into a window of hours that goes past midnight."""
    return table(spark, sf_dir, "events").select("event_id", ((F.hour("ts") >= 22) | (F.hour("ts") < 7)).alias("quiet"))


@query(f"with {THREADS} select thread_id, lifecycle, resonant from thread where (lifecycle = 'CONFIRMED' or resonant) and thread_id % 2 = 1")
def open_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that nobody has read: threads of even id stand for those read."""
    return threads(spark, sf_dir).where("(lifecycle = 'CONFIRMED' or resonant) and thread_id % 2 = 1").select("thread_id", "lifecycle", "resonant")


@query("select o_orderkey as thread_id, coalesce(c_name, 'Unknown') as target from orders left join (select c_custkey, c_name from customer where c_acctbal > 0) on c_custkey = o_custkey")
def alert_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with the name of their target, where that is still known."""
    names = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, sf_dir, "orders").join(names, "o_custkey", "left").select(F.col("o_orderkey").alias("thread_id"), F.coalesce("c_name", F.lit("Unknown")).alias("target"))


@query(f"""with {MEMBERS}, l as (select thread_id, list_sort(list(distinct publisher)) as names from member group by 1)
select thread_id, array_to_string(names[1:3], ', ') || case when len(names) > 3 then ' +' || (len(names) - 3) else '' end as label from l""")
def lens_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three publishers of a thread by name, and how many more there are."""
    named = members(spark, sf_dir).groupBy("thread_id").agg(F.sort_array(F.collect_set("publisher")).alias("names"))
    more = F.when(F.size("names") > 3, F.concat(F.lit(" +"), (F.size("names") - 3).cast("string"))).otherwise("")
    return named.select("thread_id", F.concat(F.array_join(F.slice("names", 1, 3).cast("array<string>"), ", "), more).alias("label"))


@query("select sha256(html) as hash, count(*) as n, min(page_id) as first_page from pages group by 1")
def conditional_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies by their digest: a second page of the same digest brings nothing new."""
    return table(spark, sf_dir, "pages").groupBy(F.sha2("html", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query(f"""with {MEMBERS}, s as (select thread_id, list_sort(list(distinct publisher) filter (tier = 'primary')) as cited, list_sort(list(distinct publisher)) as every from member group by 1)
select thread_id, coalesce(array_to_string(cited, ','), '') as cited, array_to_string(list_filter(every, lambda p: not coalesce(list_contains(cited, p), false)), ',') as rest from s""")
def cited_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers that a thread cites, and its others."""
    sets = members(spark, sf_dir).groupBy("thread_id").agg(F.sort_array(F.collect_set(F.when(F.col("tier") == "primary", F.col("publisher")))).alias("cited"), F.sort_array(F.collect_set("publisher")).alias("every"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return sets.select("thread_id", text(F.col("cited")).alias("cited"), text(F.array_except("every", "cited")).alias("rest"))


@query("select r_regionkey as collection_id, r_name as title, string_agg(n_name, ',' order by n_name) as presets from region join nation on n_regionkey = r_regionkey group by 1, 2")
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections with their presets in order."""
    presets = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("presets"))
    return table(spark, sf_dir, "region").join(presets, "r_regionkey").select(F.col("r_regionkey").alias("collection_id"), F.col("r_name").alias("title"), "presets")


@query("select p_partkey from part where p_size > 25 and not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)")
def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions that are chosen and not in use already."""
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey").join(used, "p_partkey", "left_anti")


@query("select 'account' as kind, s_suppkey as id from supplier union all select 'keyword', p_partkey from part where p_size < 10 union all select 'url', page_id from pages")
def hybrid_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of all kinds as one list of routes."""
    part = lambda name, key, kind, where="true": table(spark, sf_dir, name).where(where).select(F.lit(kind).alias("kind"), F.col(key).alias("id"))
    return part("supplier", "s_suppkey", "account").unionByName(part("part", "p_partkey", "keyword", "p_size < 10")).unionByName(part("pages", "page_id", "url"))


@query(f"""with {THREADS}, k as (select *, min(thread_id) over (partition by target_id) as kept from thread),
p as (select kept, count(distinct publisher) as publishers from member join k using (thread_id) group by 1),
m as (select kept, sum(members)::bigint as members, max(case lifecycle when 'CONFIRMED' then 2 when 'CORROBORATED' then 1 else 0 end) as stage, min(first_seen) as first_seen, max(last_update) as last_update, bool_or(k.resonant) as resonant from k group by 1)
select kept, members, publishers, stage, first_seen, last_update, resonant from m join p using (kept)""")
def thread_merge_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What threads become when those of a target are merged into the oldest: publishers are counted over all members.
    The oldest comes from an aggregate and a join, so a target with many threads isn't one task's window."""
    all_ = threads(spark, sf_dir)
    oldest = all_.groupBy("target_id").agg(F.min("thread_id").alias("kept"))
    mapped = all_.join(oldest, "target_id").select("thread_id", "kept", "members", rank(F.col("lifecycle")).alias("stage"), "first_seen", "last_update", "resonant")
    merged = mapped.groupBy("kept").agg(F.sum("members").alias("members"), F.max("stage").alias("stage"), F.min("first_seen").alias("first_seen"), F.max("last_update").alias("last_update"), F.bool_or("resonant").alias("resonant"))
    publishers = members(spark, sf_dir).join(mapped.select("thread_id", "kept"), "thread_id").groupBy("kept").agg(F.countDistinct("publisher").alias("publishers"))
    return merged.join(publishers, "kept").select("kept", "members", "publishers", "stage", "first_seen", "last_update", "resonant")
