"""Streams drained over the events on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.plans.base import query, table
from sigloom.sources.bind import articles
from sigloom.sources.folders import new_folder
from sigloom.streaming.ingest import Ingest
from sigloom.streaming.ranges import in_time_ranges
from sigloom.streaming.streams import LOOKBACKS, SourceHealth, drain, event_stream, first_sightings, lookback_counts, windowed_counts


#: Ranges of time that the events come in.
PARTS = 6


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_stream(spark, f"{sf_dir}/events.parquet", PARTS)


@query("select event_type, time_bucket(interval '1 hour', ts) as start, count(*) as n from events group by 1, 2")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts from the stream, the last update of each hour."""
    found = drain(windowed_counts(_events(spark, sf_dir)), "counts", "update", new_folder(spark, "stream"))
    last = found.groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"))
    return last.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""with l(hours, every) as (values {", ".join(map(str, LOOKBACKS))}), w as (select event_type, hours, (floor(epoch(ts) / (every * 3600))::bigint + 1 + unnest(range(hours // every))) * every * 3600 as e from events, l)
select event_type, hours, timestamp '1970-01-01' + to_seconds(e) as "end", count(*) as n from w group by 1, 2, 3""")
def stream_lookbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the last 12 hours, day and week from the stream, the last update of each window."""
    found = drain(lookback_counts(_events(spark, sf_dir)), "lookbacks", "update", new_folder(spark, "stream"))
    last = found.groupBy("event_type", "hours", "end").agg(F.max_by("n", "batch").alias("n"))
    return last.withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("select count(*) as n, count(distinct event_id) as ids from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many first sightings a stream lets through."""
    found = drain(first_sightings(_events(spark, sf_dir)), "dedup", "append", new_folder(spark, "stream"))
    return found.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query()
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source health from the stream: its state goes from one range of time to the next."""
    folder = new_folder(spark, "stream")
    found = drain(_events(spark, sf_dir), "health", "append", folder, SourceHealth(spark, f"{folder}/state").step)
    latest = found.groupBy("source").agg(F.max_by(F.struct("failures", "state", "wait_minutes"), "batch").alias("s"))
    return latest.select("source", "s.failures", "s.state", "s.wait_minutes")


#: Ranges of time that the articles come in.
ARRIVALS = 4


@query()
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads of the stream of articles: each article's thread, how near it was, and the thread's state at the end, if it
    is still in the pool.  The stand-in judge says event from a similarity of 0.35 on, as these vectors are spread wide."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    rows = articles(spark, sf_dir).select("id", "title", "tier", F.col("created_at").cast("timestamp").alias("at")).join(vectors, "id")
    found = Ingest(spark, new_folder(spark, "ingest"), lambda s, thread, article: F.when(s >= 0.35, "event").otherwise("different"))
    found.drain(in_time_ranges(rows, "at", ARRIVALS, "arrivals"))
    last = found.threads(ARRIVALS - 1).select("thread_id", "n", "has_primary", "rumor", F.col("last_update").cast("timestamp_ntz").alias("last_update"))
    return found.members().select("id", "thread_id", F.round("similarity", 5).alias("similarity")).join(last, "thread_id", "left")
