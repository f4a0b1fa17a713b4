"""Arrival-order threads: candidates found in parallel, joined by pointers.

Each article's nearest earlier articles come from a block join that keeps the best few only.  A judge looks at a pair
alone, so each article points to the first of its candidates that is the same event; threads are where the pointers
end, and are found by joins that double the distance each round, whatever the size of a thread.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.operators.similarity import best_matches
from sigloom.sources.folders import ready_checkpoints

#: The similarity from which a candidate counts, and from which it is the same event at once.
FLOOR, SURE, CANDIDATES = 0.05, 0.80, 3



def rule_judge(similarity: Column, same_title: Column, shared_tokens: Column) -> Column:
    """A stand-in for a model: near-duplicate headlines are an event, headlines that share three words a story."""
    return F.when(same_title | (similarity >= SURE), "event").when(shared_tokens >= 3, "story").otherwise("different")


def ends_of(pointers: DataFrame) -> DataFrame:
    """pointers (id, to: null or itself at the end) -> id, end.  Pointers must not go in circles."""
    now = pointers.select("id", F.coalesce("to", "id").alias("end")).checkpoint()
    while True:
        further = now.select(F.col("id").alias("end"), F.col("end").alias("next"))
        fresh = now.join(further, "end").select("id", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")).checkpoint()
        now = fresh.select("id", "end")
        if fresh.where("moved").isEmpty():
            return now


def arrival_threads(rows: DataFrame, floor: float = FLOOR, judge: Callable[[Column, Column, Column], Column] = rule_judge) -> DataFrame:
    """rows (id, title, v of unit length) -> id, thread_id (the first member), storyline_id (its oldest kin).

    Articles come in order of id.  An article joins the thread of the likeliest of its best candidates that the judge
    calls the same event; kin it calls a story only share a storyline; else it begins a thread.  The judge takes the
    similarity, whether the titles agree and how many of their words do, as columns.
    """
    ready_checkpoints(rows.sparkSession)
    pairs = best_matches(rows, rows, "id", "v", CANDIDATES, floor, earlier=True)
    titles = rows.select("id", T.normalize_title(F.col("title")).alias("norm"), F.array_distinct(T.title_tokens(F.col("title"))).alias("tokens"))
    others = titles.select(F.col("id").alias("other"), F.col("norm").alias("other_norm"), F.col("tokens").alias("other_tokens"))
    found = pairs.join(titles, "id").join(others, "other")
    verdict = judge(F.col("similarity"), F.col("norm") == F.col("other_norm"), F.size(F.array_intersect("tokens", "other_tokens")))
    judged = found.select("id", "other", "place", verdict.alias("verdict"))
    first = lambda v: F.min_by("other", F.when(F.col("verdict") == v, F.col("place")))
    kin = judged.groupBy("id").agg(first("event").alias("event"), first("story").alias("story")).checkpoint()
    threads = ends_of(rows.select("id").join(kin, "id", "left").select("id", F.col("event").alias("to")))
    # A thread's storyline is that of the thread that its first member is kin to.
    of_kin = kin.where("event is null and story is not null").join(threads.select(F.col("id").alias("story"), F.col("end").alias("to")), "story")
    stories = ends_of(threads.where("id = end").select("id").join(of_kin.select("id", "to"), "id", "left"))
    return threads.withColumnRenamed("end", "thread_id").join(stories.select(F.col("id").alias("thread_id"), F.col("end").alias("storyline_id")), "thread_id").select("id", "thread_id", "storyline_id")
