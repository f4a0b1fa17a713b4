"""The driver's tables as the concepts of the radar.  The bindings are a convention: they make every query answerable
and comparable, and say nothing about news.  The SQL beside each is the same binding for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.plans.base import table


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles."""
    number = F.substring("source", 4, 10).cast("int")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.trim(F.regexp_extract("text", r"^[^\n.]*", 0)).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("publisher"),
        "lang",
        F.concat(F.lit("https://"), "source", F.lit(".example/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.when(number < 4, "primary").when(number < 10, "curated").otherwise("aggregated").alias("tier"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int))").alias("created_at"),
    )


ARTICLES = """article as (
  select doc_id as id, trim(regexp_extract(text, '^[^\\n.]*')) as title, text as content, source as publisher, lang,
         'https://' || source || '.example/' || lang || '/' || doc_id as url,
         case when substr(source, 4)::int < 4 then 'primary' when substr(source, 4)::int < 10 then 'curated' else 'aggregated' end as tier,
         timestamp '2024-01-01' + to_minutes(doc_id) as created_at
  from documents)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the members of threads."""
    tier = F.when(F.col("l_returnflag") == "A", "primary").when(F.col("l_returnflag") == "R", "curated").otherwise("aggregated")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("thread_id"), F.col("l_suppkey").alias("publisher"), tier.alias("tier"), F.col("l_shipdate").alias("at"),
        F.col("l_partkey").alias("entity_id"), F.col("l_linenumber").alias("no"),
    )


MEMBERS = """member as (
  select l_orderkey as thread_id, l_suppkey as publisher, l_shipdate as "at", l_partkey as entity_id, l_linenumber as no,
         case l_returnflag when 'A' then 'primary' when 'R' then 'curated' else 'aggregated' end as tier
  from lineitem)"""


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with line items as threads: one aggregation by thread, then joins on unique keys."""
    from sigloom.operators.threads import rollup

    rolled = rollup(members(spark, sf_dir))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("thread_id"), F.col("o_custkey").alias("target_id"), (F.col("o_orderstatus") == "F").alias("summarised"),
        F.col("o_orderdate").alias("summarised_at"), (F.col("o_orderpriority") == "1-URGENT").alias("resonant"), F.col("o_totalprice").alias("weight"),
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("target_id"), F.col("c_name").alias("target"), F.col("c_mktsegment").alias("section"), (F.col("c_acctbal") > 5000).alias("high_attention"))
    return rolled.join(orders, "thread_id").join(customers, "target_id")


THREADS = f"""{MEMBERS},
rolled as (
  select thread_id, count(*) as members, count(distinct publisher) as publishers,
         case when bool_or(tier = 'primary') then 'CONFIRMED' when count(distinct publisher) >= 2 then 'CORROBORATED' else 'LEAD' end as lifecycle,
         min("at") as first_seen, max("at") as last_update
  from member group by 1),
thread as (
  select r.*, o_custkey as target_id, o_orderstatus = 'F' as summarised, o_orderdate as summarised_at, o_orderpriority = '1-URGENT' as resonant,
         o_totalprice as weight, c_name as target, c_mktsegment as section, c_acctbal > 5000 as high_attention
  from rolled r join orders on o_orderkey = thread_id join customer on c_custkey = o_custkey)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a ledger of model calls."""
    k = F.get_json_object("props", "$.k").cast("int")
    model = F.when(k % 4 == 0, "small-flash").when(k % 4 == 1, "large-pro").when(k % 4 == 2, "text-embedding").otherwise("other-model")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), "user_id", F.col("event_type").alias("action"), model.alias("model"), F.floor("value").cast("bigint").alias("tokens"), k.alias("k"))


USAGE = """usage as (
  select event_id, ts as "at", user_id, event_type as action, floor(value)::bigint as tokens, json_extract_string(props, '$.k')::int as k,
         case json_extract_string(props, '$.k')::int % 4 when 0 then 'small-flash' when 1 then 'large-pro' when 2 then 'text-embedding' else 'other-model' end as model
  from events)"""
