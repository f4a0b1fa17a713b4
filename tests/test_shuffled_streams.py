"""Streams over several files that aren't cut by time."""

from pyspark.sql import functions as F

from sigloom.plans import state_queries, stream_queries


def test_streams_of_shuffled_files_are_whole(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):  # each file spans the whole time, and the last comes first
        part = events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)
        edge = part.agg(F.percentile_approx(F.col("ts").cast("timestamp").cast("double"), 0.5)).first()[0]
        late = F.col("ts").cast("timestamp").cast("double") >= edge
        for rows in (part.where(late), part.where(~late)):
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    sf = str(tmp_path)
    counts = {(r.event_type, r.start): r.n for r in stream_queries.stream_counts(spark, sf).collect()}
    want = events.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n")).collect()
    assert counts == {(r.event_type, r.start): r.n for r in want}
    found = stream_queries.stream_dedup(spark, sf).first()
    assert found.n == found.ids == events.select("event_id").distinct().count()
    health = {(r.source, r.failures, r.state) for r in stream_queries.stream_health(spark, sf).collect()}
    assert health == {(r.source, r.failures, r.state) for r in state_queries.health_final_state(spark, sf).collect()}
