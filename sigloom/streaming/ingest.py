"""Semantic ingest as a stream: articles join the threads whose running centroids they are near.

A thread is its first article's id, its title, how many members it has, their mean and its times.  The threads of the
last POOL_DAYS, by event time, are a table that each micro-batch reads and writes anew under its own number, so a batch
that runs again starts from the same threads.  Threads that fall out of that time leave the table; who belongs to them
stays in the table of members.

A micro-batch is compared with all threads block by block and keeps each article's best few; articles of the batch are
also compared with those that came before them there, which stand for their threads by their own vectors.  So an
article points to a thread or to an earlier article, and follows the pointers to its thread; centroids move when the
batch is done.  In batches of one article this is the walk from article to article.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.functions import vectors as V
from sigloom.operators.clustering import CANDIDATES, FLOOR, SURE, ends_of
from sigloom.operators.similarity import best_matches
from sigloom.sources.folders import ready_checkpoints

#: Fixed value: days that a thread stays a candidate after its last article.
POOL_DAYS = 30

THREAD = "thread_id bigint, title string, n bigint, centroid array<double>, first_seen timestamp, last_update timestamp, has_primary boolean, rumor boolean"
MEMBER = "id bigint, thread_id bigint, similarity double, at timestamp"

#: similarity, title of the thread, title of the article -> 'event', 'story', 'different', or null where it can't say.
Judge = Callable[[Column, Column, Column], Column]


def near_headlines(a: Column, b: Column) -> Column:
    """Whether two titles are copies: normalised they agree, or nearly, and so do their versions and dates."""
    words = lambda t: F.filter(F.split(T.normalize_title(t), " "), lambda w: w != "")
    long = (F.size(words(a)) >= T.LEAST_TOKENS) & (F.size(words(b)) >= T.LEAST_TOKENS)
    signals = F.array_sort(F.array_distinct(T.signal_tokens(a))) == F.array_sort(F.array_distinct(T.signal_tokens(b)))
    like = (T.normalize_title(a) == T.normalize_title(b)) | (T.jaccard(F.array_distinct(T.title_tokens(a)), F.array_distinct(T.title_tokens(b))) >= T.NEAR_TITLE)
    return F.coalesce(long & signals & like, F.lit(False))


def by_headline(similarity: Column, thread: Column, article: Column) -> Column:
    """A stand-in for a model: a copied headline is an event, three shared words are a story."""
    shared = F.size(F.array_intersect(F.array_distinct(T.title_tokens(thread)), F.array_distinct(T.title_tokens(article))))
    return F.when(near_headlines(thread, article), "event").when(shared >= 3, "story").otherwise("different")


def decide(candidates: DataFrame, judge: Judge | None) -> DataFrame:
    """candidates (id, place, other, similarity, title, other_title) -> id, event, story: what each article joins or is kin to.

    The best candidate is joined unasked if it is SURE and its headline a copy, or without a judge.  Else the judge goes
    through the candidates, the best first, until it finds an event or can't say; the first story before that is kin."""
    best = F.col("place") == 1
    unasked = best & ((F.col("similarity") >= SURE) & near_headlines(F.col("other_title"), F.col("title")) if judge else F.lit(True))
    asked = judge(F.col("similarity"), F.col("other_title"), F.col("title")) if judge else F.lit(None).cast("string")
    said = candidates.select("id", "place", "other", F.when(unasked, "event").otherwise(asked).alias("said"))
    # There are as many as CANDIDATES to an article.
    walk = said.groupBy("id").agg(
        F.min(F.when(F.col("said").isNull() | (F.col("said") == "event"), F.col("place"))).alias("stop"),
        F.array_sort(F.collect_list(F.struct("place", "other", "said"))).alias("all"),
    )
    first = lambda what: F.get(F.filter("all", lambda c: (c["said"] == what) & (c["place"] <= F.coalesce("stop", F.lit(CANDIDATES)))), F.lit(0))["other"]
    return walk.select("id", first("event").alias("event"), first("story").alias("story"))


def _unit(rows: DataFrame, key: str, vector: str, mean: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(mean)).select(F.col(key).alias("id"), V.unit(V.centred(F.col(vector), F.col("mean"))).alias("c"))  # the mean is one row


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Sum of each place of ``v`` by keys, as an array."""
    cells = rows.select(*keys, F.posexplode("v").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("sums"))


class Ingest:
    """A folder of threads, members and sums of vectors, by batch."""

    def __init__(self, spark: SparkSession, folder: str, judge: Judge | None = by_headline, floor: float = FLOOR, pool_days: int = POOL_DAYS, centre: bool = True):
        self.spark, self.folder, self.judge, self.floor, self.pool_days, self.centre = spark, folder, judge, floor, pool_days, centre
        ready_checkpoints(spark)

    def threads(self, batch: int) -> DataFrame:
        """The threads after a batch; none before the first."""
        return self.spark.createDataFrame([], THREAD) if batch < 0 else self.spark.read.schema(THREAD).parquet(f"{self.folder}/threads/{batch:06d}")

    def members(self) -> DataFrame:
        """Every article with its thread and how near it was to what it joined."""
        return self.spark.read.schema(MEMBER).option("recursiveFileLookup", "true").parquet(f"{self.folder}/members")

    def _write(self, rows: DataFrame, name: str, batch: int) -> DataFrame:
        path = f"{self.folder}/{name}/{batch:06d}"
        rows.write.mode("overwrite").parquet(path)  # a batch that runs again writes the same folder
        return self.spark.read.schema(rows.schema).parquet(path)

    def _mean(self, rows: DataFrame, batch: int) -> DataFrame:
        """The mean of all vectors so far: a sum that goes on from the batch before, one row."""
        now = rows.agg(F.count("v").alias("n")).crossJoin(_sums(rows))
        if batch > 0:
            before = self.spark.read.parquet(f"{self.folder}/sums/{batch - 1:06d}").select(F.col("n").alias("m"), F.col("sums").alias("old"))
            now = now.crossJoin(before).select((F.col("n") + F.col("m")).alias("n"), F.zip_with("sums", "old", lambda a, b: F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))).alias("sums"))
        kept = self._write(now, "sums", batch)
        return kept.select(F.transform("sums", lambda s: s / F.col("n") if self.centre else F.lit(0.0)).alias("mean"))

    def step(self, batch: DataFrame, number: int) -> None:
        """Takes in a micro-batch (id, title, tier, at, v)."""
        rows = self._write(batch.where("v is not null").select("id", "title", F.coalesce("tier", F.lit("aggregated")).alias("tier"), F.col("at").cast("timestamp").alias("at"), F.col("v").cast("array<double>").alias("v")), "batch", number)
        newest = rows.agg(F.max("at").alias("now")).first().now
        if newest is None:
            for name, empty in (("threads", self.threads(number - 1)), ("members", self.spark.createDataFrame([], MEMBER))):
                self._write(empty, name, number)
            if number > 0:
                self._write(self.spark.read.parquet(f"{self.folder}/sums/{number - 1:06d}"), "sums", number)
            return
        pool = self.threads(number - 1).where(F.col("last_update") >= F.lit(newest) - F.make_dt_interval(F.lit(self.pool_days)))
        mean = self._mean(rows, number)
        asked = _unit(rows, "id", "v", mean).checkpoint()
        near = best_matches(asked, asked, "id", "c", CANDIDATES, self.floor, earlier=True)
        if not pool.isEmpty():
            near = near.union(best_matches(asked, _unit(pool, "thread_id", "centroid", mean), "id", "c", CANDIDATES, self.floor))
        # Equally near: threads in the order in which they began.
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
        near = near.select("id", "other", "similarity", place.alias("place")).where(F.col("place") <= CANDIDATES)
        titles = rows.select(F.col("id").alias("other"), F.col("title").alias("other_title")).union(pool.select("thread_id", "title"))
        near = near.join(titles, "other").join(rows.select("id", "title"), "id").checkpoint()
        chosen = decide(near, self.judge).select("id", F.col("event").alias("to"))
        points = rows.select("id").join(chosen, "id", "left").checkpoint()
        known = pool.select(F.col("thread_id").alias("id")).join(points.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
        ends = ends_of(points.union(known.select("id", F.lit(None).cast("bigint"))))
        sims = near.select("id", F.col("other").alias("to"), "similarity")
        joined = rows.join(ends, "id").join(points, "id").join(sims, ["id", "to"], "left")
        members = self._write(joined.select("id", F.col("end").alias("thread_id"), "similarity", "at"), "members", number)
        new = rows.join(members.select("id", "thread_id"), "id")
        high = F.col("tier").isin("primary", "curated")
        grown = new.groupBy("thread_id").agg(
            F.count("*").alias("more"), F.min("at").alias("began"), F.max("at").alias("moved"), F.bool_or(F.col("tier") == "primary").alias("primary"), F.bool_or(high).alias("high"),
            F.min_by(F.substring("title", 1, 120), "id").alias("named"),
        ).join(_sums(new, "thread_id"), "thread_id")
        n, m = F.coalesce("had", F.lit(0)), F.coalesce("more", F.lit(0))
        mean_of = F.when(F.col("had").isNull(), F.transform("sums", lambda s: s / F.col("more"))).when(F.col("more").isNull(), F.col("centroid"))
        after = pool.withColumnRenamed("n", "had").join(grown, "thread_id", "full").select(
            "thread_id", F.coalesce("title", "named").alias("title"), (n + m).alias("n"),
            mean_of.otherwise(F.zip_with("centroid", "sums", lambda c, s: (c * F.col("had") + s) / (F.col("had") + F.col("more")))).alias("centroid"),
            F.least("first_seen", "began").alias("first_seen"), F.greatest("last_update", "moved").alias("last_update"),
            (F.coalesce("has_primary", F.lit(False)) | F.coalesce("primary", F.lit(False))).alias("has_primary"), (F.coalesce("rumor", F.lit(True)) & ~F.coalesce("high", F.lit(False))).alias("rumor"),
        )
        self._write(after, "threads", number)

    def drain(self, stream: DataFrame) -> None:
        """Takes in all that a stream of articles holds now, batch by batch."""
        query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{self.folder}/progress").foreachBatch(self.step).start()
        query.awaitTermination()
