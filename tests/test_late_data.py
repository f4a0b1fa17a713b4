"""Streams with rows that come late: what is within the watermark counts, what is beyond is left out, and state goes."""

import datetime as dt

from pyspark.sql import functions as F

from sigloom.sources.folders import new_folder
from sigloom.streaming import streams

START = dt.datetime(2024, 1, 1)


def late_rows():
    """event_id, arrival and time: an event every ten minutes of ten days; some half an hour late, some four days."""
    rows = []
    for i in range(1440):
        at = START + dt.timedelta(minutes=10 * i)
        lag = dt.timedelta(minutes=30) if i % 7 == 3 else dt.timedelta(days=4) if i % 50 == 49 else dt.timedelta()
        rows.append((i, at, at - lag, "view" if i % 3 else "click"))
    return rows


def table(spark):
    path = new_folder(spark, "late")
    spark.createDataFrame(late_rows(), "event_id bigint, arrived timestamp, ts timestamp, event_type string").repartition(5).write.parquet(path)
    return path


def plain(parts, keys_of, late):
    """Counts by key; a key is (.., end).  Rows are judged by the watermark that all batches but the last before set."""
    counts, mark, waiting = {}, None, None
    for batch in parts:
        for row in batch:
            for key in keys_of(row):
                if mark is None or key[-1] > mark:
                    counts[key] = counts.get(key, 0) + 1
        newest = max(k[-1] if late[1] else r[2] for r in batch for k in keys_of(r)) - late[0]
        mark, waiting = waiting, newest if waiting is None else max(waiting, newest)
    return counts


def batches(spark, path, parts):
    seen, at = [], {r[0]: r for r in late_rows()}
    stream = streams.event_stream(spark, path, parts, "arrived")
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", new_folder(spark, "seen")).foreachBatch(lambda df, _: seen.append([at[r.event_id] for r in df.select("event_id").collect()])).start().awaitTermination()
    return seen


def test_hours_and_lookbacks_leave_out_what_is_too_late(spark):
    path = table(spark)
    parts = batches(spark, path, 8)
    assert len(parts) == 8 and sum(map(len, parts)) == 1440
    hour = dt.timedelta(hours=1)
    found = streams.drain(streams.windowed_counts(streams.event_stream(spark, path, 8, "arrived")), "c", "update", new_folder(spark, "late"))
    got = {(r.event_type, r.start + hour): r.n for r in found.groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n")).collect()}
    ends = lambda r: [(r[3], START + hour * ((r[2] - START) // hour + 1))]
    want = plain(parts, ends, (hour, False))
    assert got == want and sum(want.values()) < 1440  # four days late is too late, half an hour is not

    epoch = dt.datetime(1970, 1, 1)

    def windows(r):
        out = []
        for hours, every in streams.LOOKBACKS:
            step = dt.timedelta(hours=every)
            first = epoch + step * ((r[2] - epoch) // step + 1)
            out += [(r[3], hours, first + k * step) for k in range(hours // every)]
        return out

    found = streams.drain(streams.lookback_counts(streams.event_stream(spark, path, 8, "arrived")), "l", "update", new_folder(spark, "late"))
    got = {(r.event_type, r.hours, r.end): r.n for r in found.groupBy("event_type", "hours", "end").agg(F.max_by("n", "batch").alias("n")).collect()}
    longest = max(h + e for h, e in streams.LOOKBACKS)
    want = plain(parts, windows, (dt.timedelta(hours=longest + 1), True))
    assert got == want
    full = {}
    for r in late_rows():
        for key in windows(r):
            full[key] = full.get(key, 0) + 1
    short = [k for k in full if got.get(k, 0) < full[k]]
    assert 0 < len(short) < len(full) / 2


def test_state_goes_as_time_moves_on(spark):
    stream = streams.windowed_counts(streams.event_stream(spark, table(spark), 8))
    query = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", new_folder(spark, "state")).format("memory").queryName("late_state").start()
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert max(kept) < 2 * 240 * 0.4  # of the 480 hours and types that there are
