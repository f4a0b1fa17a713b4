"""Title families, injected judges, long vectors and walked states against plain versions."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.functions import vectors as V
from sigloom.operators import clustering, health, titles
from sigloom.operators.similarity import best_matches
from sigloom.sources import cases


def test_families_are_those_of_a_walk(spark):
    rng = np.random.default_rng(8)
    base = [f"word{k}" for k in range(10)]
    rows = []
    for thread in range(6):
        for no in range(40):
            words = list(base)
            for at in rng.integers(0, 10, int(rng.integers(0, 4))):
                words[int(at)] = f"other{int(rng.integers(0, 3))}"
            rows.append((f"h{thread}", no, "p", " ".join(words[: int(rng.integers(2, 11))] if rng.random() < 0.3 else words) + (" v1.2" if rng.random() < 0.3 else "")))
    rows += cases.TITLED
    table = spark.createDataFrame(rows, cases.TITLE)
    parts = table.select("thread", "no", T.normalize_title(F.col("title")).alias("norm"), T.title_tokens(F.col("title")).alias("tokens"), T.signal_tokens(F.col("title")).alias("signals")).collect()

    def near(a, b):
        if not a.norm or not b.norm or min(len(a.tokens), len(b.tokens)) < 3 or set(a.signals) != set(b.signals):
            return False
        x, y = set(a.tokens), set(b.tokens)
        return a.norm == b.norm or len(x & y) >= 0.8 * len(x | y)

    want = {}
    for r in sorted(parts, key=lambda r: (r.thread, r.no)):
        firsts = want.setdefault(r.thread, [])
        if not any(near(r, f) for f in firsts):
            firsts.append(r)
    assert {r.thread: r.families for r in titles.title_families(table).collect()} == {t: len(f) for t, f in want.items()}
    assert titles.title_families(table.limit(0)).count() == 0


def test_versions_and_dates_keep_titles_apart(spark):
    rows = [(1, "Maker ships big engine v0.117.0 today"), (2, "Maker ships big engine v0.117.1 today"), (3, "Maker ships big engine v0.117.0 right today"), (4, "Sales grow strongly in July again"), (5, "Sales grow strongly in June again")]
    found = titles.near_titles(spark.createDataFrame(rows, "id bigint, title string")).collect()
    assert [(r.a, r.b) for r in found] == [(1, 3)]


def walk_threads(rows, floor, judge, k=3):
    thread, story = {}, {}
    for i, (key, _, v) in enumerate(rows):
        near = sorted(((-float(np.dot(v, w)), other) for other, _, w in rows[:i] if np.dot(v, w) >= floor))[:k]
        kin = None
        for s, other in near:
            verdict = judge(-s, key, other)
            if verdict == "event":
                thread[key] = thread[other]
                break
            if verdict == "story" and kin is None:
                kin = thread[other]
        own = thread.setdefault(key, key)
        story.setdefault(own, story[kin] if kin is not None else own)
    return {key: (thread[key], story[thread[key]]) for key, *_ in rows}


def test_threads_by_pointers_are_those_of_a_walk_with_any_judge(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, f"title {i}", v.tolist()) for i, v in enumerate(x)]

    def judge(similarity, same, shared):
        return F.when(similarity >= 0.85, "event").when(similarity >= 0.7, "story").otherwise("different")

    found = clustering.arrival_threads(spark.createDataFrame(rows, "id bigint, title string, v array<double>"), 0.3, judge).collect()
    want = walk_threads(rows, 0.3, lambda s, *_: "event" if s >= 0.85 else "story" if s >= 0.7 else "different")
    assert {r.id: (r.thread_id, r.storyline_id) for r in found} == want and len({t for t, _ in want.values()}) > 20


def test_vectors_of_a_thousand_places(spark):
    x = np.random.default_rng(1).normal(size=(30, 1024))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(98, [0.0] * 1024), (99, None)], "id bigint, v array<double>")
    mean = V.mean_vector(table, "v").first().mean
    assert np.allclose(mean, x.sum(axis=0) / 31)
    got = {r.id: r.u for r in table.select("id", V.unit(F.col("v")).alias("u")).collect()}
    assert np.allclose([got[i] for i in range(30)], x / np.linalg.norm(x, axis=1)[:, None]) and got[98] == [0.0] * 1024 and got[99] is None
    odd = spark.createDataFrame([([1.0, None],), ([3.0, 4.0, 5.0],), ([],), (None,)], "v array<double>")
    assert V.mean_vector(odd, "v").first().mean == [2.0, 4.0, 5.0]
    earlier = best_matches(table.where("id < 30").select("id", V.unit(F.col("v")).alias("v")), table.where("id < 30").select("id", V.unit(F.col("v")).alias("v")), "id", "v", 2, -1.0, earlier=True).collect()
    assert all(r.other < r.id for r in earlier) and len(earlier) == 2 * 28 + 1


def test_states_are_walked_in_order_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        at = dt.datetime(2024, 1, 1)
        rng = np.random.default_rng(3)
        rows = [(int(rng.integers(3)) if rng.random() < 0.9 else None, at + dt.timedelta(minutes=int(rng.integers(3000))), i, bool(rng.random() < 0.6), float(i)) for i in range(200)]
        found = {r.source: r for r in health.health_states(spark.createDataFrame(rows, "source bigint, at timestamp_ntz, event_id bigint, ok boolean, latency double")).collect()}
        assert set(found) == {None, 0, 1, 2}
        for source, r in found.items():
            failures = 0
            for _, _, _, ok, _ in sorted((x for x in rows if x[0] == source), key=lambda x: (x[1], x[2])):
                failures = 0 if ok else failures + 1
            assert r.failures == failures and (r.until is None) == (failures == 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
