"""The same results from streams: counts in event-time windows, look-backs, first sightings, and source health with kept
state.  Batches are ranges of time, so watermarks are short and state goes as time moves on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.health import BACKOFF, DEGRADED, QUARANTINED
from sigloom.streaming.ranges import in_time_ranges


def event_stream(spark: SparkSession, path: str, parts: int, arrival: str = "ts") -> DataFrame:
    """Events as a stream of ranges of ``arrival``, by default of their own time, so that none of a batch is older than
    those of the batch before, in whatever order the table's files come."""
    events = spark.read.parquet(path)
    return in_time_ranges(events.withColumn("ts", F.col("ts").cast("timestamp")).where("ts is not null"), arrival, parts, "events")


def windowed_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each type and hour; later ones than the watermark are left out."""
    rows = events.withWatermark("ts", late).groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n")


#: Hours that look-backs reach, and hours between their ends.
LOOKBACKS = ((12, 1), (24, 2), (168, 12))


def lookback_counts(events: DataFrame, late_hours: int = 1) -> DataFrame:
    """Events of each type in sliding windows of all look-backs: hours, end and n, in one stream with one state.

    An event falls into the windows [end - hours, end).  The watermark is set on the ends: the furthest end that an event
    has is LOOKBACKS' longest after it, so a delay of that and ``late_hours`` keeps a window until it ended that long
    before the newest event; later events are left out, and the window's state goes.  Spark judges a batch's rows by the
    watermark that stood before the batch before it, so lateness is what that allows, never less than ``late_hours``."""
    second = F.unix_seconds("ts")

    def windows_of(hours: int, every: int) -> Column:
        step = 3600 * every
        first = (F.floor(second / step) + 1) * step
        return F.transform(F.sequence(F.lit(0), F.lit(hours // every - 1)), lambda k: F.struct(F.lit(hours).alias("hours"), F.timestamp_seconds(first + k * step).alias("end")))

    windows = [windows_of(hours, every) for hours, every in LOOKBACKS]
    rows = events.select("event_type", F.explode(F.concat(*windows)).alias("w")).select("event_type", "w.hours", "w.end")
    longest = max(h + e for h, e in LOOKBACKS)
    return rows.withWatermark("end", f"{longest + late_hours} hours").groupBy("event_type", "hours", "end").agg(F.count("*").alias("n"))


def first_sightings(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event id once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


HEALTH = "source bigint, failures bigint"


class SourceHealth:
    """Failures in a row of each source (user_id), kept between batches as a table under each batch's number, so that a
    batch that runs again starts from the same state; batches must come in order of time.

    A success ends what was before it, so a batch adds to a source the failures after its last success there, and to what
    was kept where it has none.  Failures only grow between successes, so they tell the state too."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def kept(self, batch: int) -> DataFrame:
        """The state after a batch; none before the first."""
        return self.spark.createDataFrame([], HEALTH) if batch < 0 else self.spark.read.schema(f"{HEALTH}, touched boolean").parquet(f"{self.folder}/{batch:06d}").select("source", "failures")

    def step(self, events: DataFrame, number: int) -> DataFrame:
        """Takes in a micro-batch (user_id, event_id, event_type, ts) and returns the sources that it touched."""
        at = F.struct("ts", F.col("event_id").isNull().alias("unnamed"), "event_id")  # ids that are null come last
        rows = events.select(F.col("user_id").alias("source"), at.alias("at"), F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("bad"))
        last = rows.groupBy(F.col("source").alias("who")).agg(F.max(F.when(~F.col("bad"), F.col("at"))).alias("healed"))
        failed = rows.where("bad").join(last, F.expr("source <=> who")).where("healed is null or at > healed").groupBy(F.col("source").alias("failing")).agg(F.count("*").alias("more"))
        before = self.kept(number - 1)
        touched = last.join(failed, F.expr("who <=> failing"), "left").join(before, F.expr("who <=> source"), "left")
        had = F.when(F.col("healed").isNull(), F.coalesce("failures", F.lit(0))).otherwise(0)
        touched = touched.select(F.col("who").alias("source"), (had + F.coalesce("more", F.lit(0))).alias("failures"), F.lit(True).alias("touched"))
        others = before.join(last, F.expr("source <=> who"), "left_anti").select("source", "failures", F.lit(False))
        path = f"{self.folder}/{number:06d}"
        touched.union(others).write.mode("overwrite").partitionBy("touched").parquet(path)  # a batch that runs again writes the same folder
        failures = F.col("failures")
        state = F.when(failures >= QUARANTINED, "quarantined").when(failures >= DEGRADED, "degraded").otherwise("healthy")
        wait = F.get(F.array(*[F.lit(w) for w in BACKOFF]), F.least(failures, F.lit(len(BACKOFF) - 1)).cast("int"))
        now = self.spark.read.schema(f"{HEALTH}, touched boolean").parquet(path).where("touched")
        return now.select("source", failures.cast("int").alias("failures"), state.alias("state"), wait.alias("wait_minutes"))


def drain(stream: DataFrame, name: str, mode: str, checkpoint: str, step: Callable[[DataFrame, int], DataFrame] = lambda batch, _: batch) -> DataFrame:
    """Runs a stream over all that is there now and returns what it wrote last for each row, by batch; what ``step`` makes
    of a batch is written, by default the batch."""
    spark = stream.sparkSession
    out = f"{checkpoint}/{name}-out"

    def write(batch: DataFrame, batch_id: int) -> None:
        step(batch, batch_id).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/{batch_id:06d}")  # a batch that runs again writes the same folder

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{checkpoint}/{name}").foreachBatch(write).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)
