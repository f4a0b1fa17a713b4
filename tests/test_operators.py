"""Scenarios: rules, folds, clustering, probes, pages and streams on small made-up rows."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from sigloom.functions import text as T
from sigloom.functions import vectors as V
from sigloom.operators import clustering, health, pages, probe, similarity, threads, titles
from sigloom.plans.state_queries import health_final_state
from sigloom.plans.stream_queries import stream_health


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lifecycle_never_falls(spark):
    rule = lambda primary, n, now=None: one(spark, threads.lifecycle(F.lit(primary), F.lit(n), F.lit(now) if now else None))
    assert [rule(True, 1), rule(False, 2), rule(False, 1), rule(None, None)] == ["CONFIRMED", "CORROBORATED", "LEAD", "LEAD"]
    assert rule(False, 1, "CONFIRMED") == "CONFIRMED" and rule(True, 1, "LEAD") == "CONFIRMED"


def test_resonance(spark):
    rule = lambda n, h: one(spark, threads.resonance(F.lit(n), F.lit(h)))
    assert [rule(1, 0.1), rule(3, 0.0), rule(4, 2.0)] == [0.0, 6.0, 2.0]


def test_material_growth(spark):
    rule = lambda *x: one(spark, threads.material(*[F.lit(v) for v in x]))
    assert rule(0, 1, 4, 4) and rule(1, 1, None, 1) and rule(1, 1, 4, 5)
    assert not rule(1, 1, 5, 6) and not rule(2, 1, 4, 4)


def test_sources(spark):
    tier = lambda url, base="curated": one(spark, T.tier_of(F.lit(url), F.lit(base)))
    assert tier("https://openai.com/index/x") == "primary" and tier("https://openai.com/customers/x") == "curated"
    assert tier("https://github.com/a/b") == "curated" and tier("https://github.com/a/b/releases/1") == "primary"
    assert tier("https://openai.com/index/x", "aggregated") == "aggregated" and tier("https://notopenai.com/") == "curated"
    name = lambda url, title="": one(spark, T.publisher(F.lit(url), F.lit(title)))
    assert name("https://news.google.com/x", "Big news - The Paper") == "the paper" and name("https://old.reddit.com/r/x") == "reddit.com"
    assert name("https://A.example/x") == "a.example" and name("") == "unknown"
    assert one(spark, T.firehose(F.lit("https://www.export.arxiv.org/rss"))) and not one(spark, T.firehose(F.lit("https://x.example/")))


def test_redaction(spark):
    clean = lambda text: one(spark, T.clean_pii(F.lit(text)))
    assert clean("write to a.b@c.org or 13812345678 at 12.3456, 98.7654") == "write to [email] or [phone] at [location]"
    assert clean(None) == "" and clean("in 2024 there were 120") == "in 2024 there were 120"
    assert one(spark, T.error_class(F.lit("HTTP 429 Too Many Requests"))) == "RATE_LIMITED"


def test_screens(spark):
    promo = lambda t: one(spark, T.promotional(F.lit(t)))
    assert promo("[WTS] vouchers") and promo("[H] this [W] that") and not promo("Prices cut 30% off")
    empty = lambda t, c: one(spark, T.contentless(F.lit(t), F.lit(c)))
    assert empty("Release v5.14.0", "") and not empty("v5.14.0", "x" * 90) and empty("", "short")


def test_near_titles_need_no_pairs_of_all(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta eps - Paper"), (2, "Alpha beta gamma delta eps zeta"), (3, "alpha beta"), (4, "other words here now"), (5, "alpha beta gamma delta eps")], "id bigint, title string")
    assert [(r.a, r.b) for r in titles.near_titles(rows).collect()] == [(1, 2)]


def test_block_similarity_is_that_of_numpy(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    x = np.random.default_rng(0).normal(size=(59, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")
    s = x @ x.T
    want = {(i, j) for i in range(59) for j in range(i + 1, 59) if s[i, j] >= 0.4}
    assert {(r.a, r.b) for r in similarity.similar(rows, "id", "v", 0.4).collect()} == want
    best = similarity.best_matches(rows.where("id < 5"), rows, "id", "v", 3, -1.0).collect()
    np.fill_diagonal(s, -9)
    assert {(r.id, r.place, r.other) for r in best} == {(i, k + 1, int(np.argsort(-s[i])[k])) for i in range(5) for k in range(3)}
    cos = lambda a, b: one(spark, V.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))))
    assert cos([1.0, 0.0], [0.0, 0.0]) == 0 and cos([1.0], [1.0, 0.0]) == 0 and abs(cos([1.0, 1.0], [2.0, 2.0]) - 1) < 1e-12


def test_threads_form_in_order_of_arrival(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = [0.9, 0.435889894354, 0.0]
    rows = [(1, "alpha beta gamma delta", a), (2, "alpha beta gamma other words", [0.6, 0.0, 0.8]), (3, "quite different title", near), (4, "unrelated", b), (5, "alone far", [0.0, 0.0, 1.0])]
    found = {r.id: (r.thread_id, r.storyline_id) for r in clustering.arrival_threads(spark.createDataFrame(rows, "id bigint, title string, v array<double>"), 0.5).collect()}
    assert found[1] == (1, 1) and found[2] == (2, 1) and found[3] == (1, 1) and found[4][0] == 4 and len(found) == 5


def test_probe_learns_what_can_be_told_apart(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(80):
        y = i % 2
        x = rng.normal(0, 0.15, 16) + (0.4 if y else -0.4)
        rows.append((1, i, y, x.tolist()))
        rows.append((2, i, int(rng.integers(2)), rng.normal(size=16).tolist()))
    table = spark.createDataFrame(rows, "target bigint, id bigint, y int, x array<double>")
    models = probe.train_targets(table)
    found = {r.target: r for r in models.collect()}
    assert found[1].enabled and found[1].auc > 0.99 and not found[2].enabled
    scores = probe.apply_probe(table.where("target = 1").select("id", "x"), models).collect()
    assert {r.id for r in scores if r.p > 0.5} == {i for i in range(80) if i % 2}


def test_readable_text_keeps_prose():
    html = "<html><script>var x = '</p>';</script><nav>Home</nav><p>A &amp; B tell a story.</p><p><a href=x>only a link here</a></p><footer>end</footer>"
    assert pages.readable(html) == "A & B tell a story." and pages.readable(None) == ""


def test_health_folds(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [(1, at + dt.timedelta(minutes=i), i, ok, 10.0 * (i + 1)) for i, ok in enumerate([True, False, False, True])] + [(2, at, 9, False, 1.0)]
    table = spark.createDataFrame(rows, "source bigint, at timestamp_ntz, event_id bigint, ok boolean, latency double")
    found = {r.source: r for r in health.health_states(table).collect()}
    assert (found[1].failures, found[1].state, found[1].latency) == (0, "healthy", 19)
    assert found[2].failures == 1 and found[2].until == at + dt.timedelta(minutes=2)
    paced = health.pacing(table.select(F.lit("h").alias("host"), "at", "event_id"), 300, 400).first()
    assert (paced.taken, paced.skipped) == (2, 3)


def test_the_stream_s_health_is_the_fold_s(spark):
    sf = "/root/testdata/sf0.001"
    streamed = {r.source: (r.failures, r.state) for r in stream_health(spark, sf).collect()}
    assert streamed == {r.source: (r.failures, r.state) for r in health_final_state(spark, sf).collect()}
