"""The stream of articles against a walk from article to article."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.sources.folders import new_folder
from sigloom.streaming import ingest
from sigloom.streaming.ranges import in_time_ranges

START = dt.datetime(2024, 1, 1)
ARTICLE = "id bigint, title string, tier string, at timestamp, v array<double>"


def world(n, seed=1, days=60.0):
    rng = np.random.default_rng(seed)
    topics = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        k = int(rng.integers(6))
        title = f"topic {'abcdef'[k]} makes the news once more today" if rng.random() < 0.5 else f"story{i} about topic and some other words"
        rows.append((i, title, ["primary", "curated", "aggregated", None][int(rng.integers(4))], START + dt.timedelta(days=days * i / n), (topics[k] + rng.normal(size=8) * 0.4).tolist()))
    return rows


def by_number(similarity, thread, article):
    """A judge that a walk can repeat: by similarity alone."""
    return F.when(similarity >= 0.9, "event").when(similarity >= 0.6, "story").when(similarity >= 0.3, "different")


def plain_judge(s):
    return "event" if s >= 0.9 else "story" if s >= 0.6 else "different" if s >= 0.3 else None


def walk(batches, judge=plain_judge, floor=0.05, days=30):
    """Threads as the module says, article by article."""
    threads, sums, count, where, title = {}, np.zeros(8), 0, {}, {}
    for batch in batches:
        now = max(r[3] for r in batch)
        threads = {t: x for t, x in threads.items() if x["last"] >= now - dt.timedelta(days=days)}
        for r in batch:
            sums, count = sums + r[4], count + 1
        unit = lambda v: (v - sums / count) / (np.linalg.norm(v - sums / count) or 1)  # noqa: E731, B023
        pool = {t: unit(x["sum"] / x["n"]) for t, x in threads.items()}
        for k, r in enumerate(batch):
            mine = unit(np.array(r[4]))
            near = sorted([(-float(mine @ c), t, t) for t, c in pool.items()] + [(-float(mine @ unit(np.array(o[4]))), o[0], where[o[0]]) for o in batch[:k]])
            near = [x for x in near if -x[0] >= floor][:3]
            to, title[r[0]] = None, r[1]
            for place, (s, other, thread) in enumerate(near):
                copied = place == 0 and -s >= 0.8 and title[other] == r[1]
                said = "event" if copied or not judge else judge(-s)
                if said == "event":
                    to = thread
                if said in ("event", None):
                    break
            where[r[0]] = r[0] if to is None else to
        for r in batch:
            x = threads.setdefault(where[r[0]], {"n": 0, "sum": np.zeros(8), "first": r[3], "last": r[3], "high": False})
            x["n"], x["sum"], x["last"], x["high"] = x["n"] + 1, x["sum"] + r[4], max(x["last"], r[3]), x["high"] or r[2] in ("primary", "curated")
    return where, threads


def check(spark, rows, parts, batches, judge, plain):
    found = ingest.Ingest(spark, new_folder(spark, "ingest"), judge)
    found.drain(in_time_ranges(spark.createDataFrame(rows, ARTICLE), "at", parts))
    where, threads = walk(batches, plain)
    assert {r.id: r.thread_id for r in found.members().collect()} == where
    last = {r.thread_id: r for r in found.threads(len(batches) - 1).collect()}
    assert set(last) == set(threads)
    for t, x in threads.items():
        assert last[t].n == x["n"] and np.allclose(last[t].centroid, x["sum"] / x["n"]) and last[t].rumor == (not x["high"]) and (last[t].first_seen, last[t].last_update) == (x["first"], x["last"])
    return where, threads


def split(spark, rows, parts):
    """The batches that ranges of time make."""
    seen = []
    stream = in_time_ranges(spark.createDataFrame(rows, ARTICLE), "at", parts)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", new_folder(spark, "split")).foreachBatch(lambda df, _: seen.append(sorted(r.id for r in df.select("id").collect()))).start().awaitTermination()
    at = {r[0]: r for r in rows}
    return [[at[i] for i in ids] for ids in seen]


@pytest.mark.parametrize("judge, plain", [(by_number, plain_judge), (None, None)])
def test_several_files_are_the_walk_by_batches(spark, judge, plain):
    rows = world(60)
    batches = split(spark, rows, 3)
    assert len(batches) == 3 and [r for b in batches for r in b] == rows
    where, threads = check(spark, rows, 3, batches, judge, plain)
    assert len(set(where.values())) > len(threads) or judge is None  # threads of the first month are out of the pool


def test_one_article_a_batch_is_the_walk_from_article_to_article(spark):
    rows = world(7, seed=3, days=1.0)
    batches = [[r] for r in rows]
    found = ingest.Ingest(spark, new_folder(spark, "ingest"), by_number)
    for k, batch in enumerate(batches):
        found.step(spark.createDataFrame(batch, ARTICLE), k)
    found.step(spark.createDataFrame([rows[-1]], ARTICLE), len(rows) - 1)  # a batch that runs again changes nothing
    found.step(spark.createDataFrame([], ARTICLE), len(rows))  # nor does an empty one
    where, threads = walk(batches)
    assert {r.id: r.thread_id for r in found.members().collect()} == where
    assert {r.thread_id: r.n for r in found.threads(len(rows)).collect()} == {t: x["n"] for t, x in threads.items()}


def test_what_the_judge_says(spark):
    rows = [(1, 1, 10, 0.9, "same long headline here", "same long headline here"), (2, 1, 10, 0.9, "a new model v1.2 is out", "a new model v1.3 is out"), (2, 2, 11, 0.5, "a new model v1.2 is out", "kin"), (3, 1, 10, 0.2, "x", "y")]
    table = spark.createDataFrame(rows, "id bigint, place int, other bigint, similarity double, title string, other_title string")
    said = lambda judge: {r.id: (r.event, r.story) for r in ingest.decide(table, judge).collect()}
    assert said(lambda s, a, b: F.when(b == "x", F.lit(None).cast("string")).when(s == 0.5, "event").otherwise("story")) == {1: (10, None), 2: (11, 10), 3: (None, None)}
    assert said(None) == {1: (10, None), 2: (10, None), 3: (10, None)}
    assert said(lambda s, a, b: F.lit(None).cast("string")) == {1: (10, None), 2: (None, None), 3: (None, None)}
