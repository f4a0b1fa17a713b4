"""Lines that monitors compare, and probes from their fit to what they change."""

import numpy as np

from sigloom.operators import probe
from sigloom.operators.pages import compared_lines, feed_lines, lines_of
from sigloom.plans import reads
from sigloom.sources.bind import members


def test_lines_of_a_page():
    page = """<html><head><title>no</title><script>var x = "<p>no</p>"</script><style>p{}</style></head><body>
    <div><h2>Head</h2><p>Short</p><a href="/a">Go <b>on</b></a><span>small</span><time>12:00</time>
    <span>1.4</span><p>12345</p><p>12k</p><a>bare</a><svg><a href="/s">s</a></svg><p>Short</p><a href="/x"></a><br></div></body></html>"""
    assert lines_of(page) == ["TEXT: HeadShortGoonsmall1.41234512kbareShort", "TEXT: Head", "TEXT: Short", "LINK: Goon (/a)", "LINK: bare ()"]


def test_lines_of_odd_pages():
    assert lines_of(None) == lines_of("") == lines_of("plain text") == []
    assert lines_of("<p>one<p>two") == ["TEXT: onetwo", "TEXT: two"]
    assert lines_of("</p><p>&lt;b&gt;</p></div>") == ["TEXT: <b>"]
    assert lines_of("<p>" + "x" * 100_000 + "</p>") == ["TEXT: " + "x" * 100_000]


def test_compared_lines_of_rows(spark):
    rows = spark.createDataFrame([(1, "<p>a</p>", "more"), (1, "<p>a</p>", "more"), (2, None, None)], "page_id bigint, html string, lines string")
    found = sorted((r.page_id, r.lines) for r in compared_lines(rows).collect())
    assert found == [(1, ["TEXT: a"]), (1, ["TEXT: a"]), (2, [])]
    assert compared_lines(rows.limit(0)).count() == 0


def walked_thresholds(p, y):
    ranked = sorted(set(p), reverse=True)
    add = 1.01
    for level in ranked:
        above = [b for a, b in zip(p, y, strict=True) if a >= level]
        if sum(above) >= 0.9 * len(above) and sum(above) >= 5:
            add = level
    kept = sorted(a for a, b in zip(p, y, strict=True) if b)
    veto = kept[max(0, int((1 - 0.97) * len(kept)) - 1)] if kept else 0.0
    return min(max(add, 0.8), 0.99), max(min(veto, 0.2), 0.0)


def test_thresholds_are_those_of_a_walk():
    draw = np.random.default_rng(3)
    for n in (1, 4, 30, 200):
        for _ in range(20):
            y = (draw.random(n) < 0.4).astype(float)
            p = np.round(np.clip(0.5 * y + draw.random(n) * 0.6, 0, 1), 1 if n % 4 else 3)
            assert probe.thresholds(p, y) == walked_thresholds(p.tolist(), y.tolist())


def test_probes_are_fitted_and_used(spark):
    draw = np.random.default_rng(4)
    rows = [(i, i % 3, [float(v) for v in np.eye(3)[i % 3] + 0.1 * draw.normal(size=3)]) for i in range(180)]
    labelled = [(t, i, int(k == t), x) for i, k, x in rows[:120] for t in range(2)] + [(2, i, int(i == 2), x) for i, _, x in rows[:120]]
    models = probe.train_targets(spark.createDataFrame(labelled, "target bigint, id bigint, y int, x array<double>")).collect()
    assert {m.target: m.enabled for m in models} == {0: True, 1: True, 2: False}
    kept = spark.createDataFrame(models)
    scores = probe.apply_probe(spark.createDataFrame([(i, x) for i, _, x in rows[120:]], "id bigint, x array<double>"), kept)
    scores = scores.withColumnRenamed("id", "thread_id")
    relations = spark.createDataFrame([(i, 0, "match", None if i % 2 else True) for i, k, _ in rows[120:] if k in (0, 1)], "thread_id bigint, target bigint, source string, verdict boolean")
    found = {(r.thread_id, r.target): (r.change, r.verdict) for r in probe.changes(scores, kept.where("enabled").select("target", "add_t", "veto_t"), relations).collect()}

    fitted = {m.target: m for m in models if m.enabled}
    want = {}
    for i, k, x in rows[120:]:
        for t, m in fitted.items():
            p = 1 / (1 + np.exp(-(np.array(x) @ np.array(m.weights) + m.bias)))
            if t == 0 and k in (0, 1):
                vetoed = i % 2 and p <= m.veto_t
                want[i, t] = ("vetoed", False) if vetoed else ("scored", None if i % 2 else True)
            elif p >= m.add_t:
                want[i, t] = ("added", None)
    assert found == want and {c for c, _ in want.values()} >= {"scored", "added"}


def test_feed_lines():
    feed = "<rss><channel><title>t</title>" + "".join(f"<item><title>n{i}</title><link>https://e.org/{i}</link></item>" for i in range(12)) + "</channel></rss>"
    assert feed_lines(feed) == [x for i in range(10) for x in (f"TEXT: n{i}", f"LINK: n{i} (https://e.org/{i})")]
    assert feed_lines(None) == feed_lines("") == feed_lines("<rss/>") == feed_lines("<a>") == ["TEXT: No items found in feed."]
    assert feed_lines('<feed xmlns="x"><entry><title>A <b>b</b></title><link href="u"/></entry><entry/></feed>') == ["TEXT: A b", "LINK: A b (u)", "TEXT: "]


def test_material_replay_is_a_walk_over_all_members(spark):
    found = {r.thread_id: (r.baseline, r.last_material) for r in reads.material_replay(spark, "/root/testdata/sf0.001").collect()}
    threads = {}
    for m in members(spark, "/root/testdata/sf0.001").collect():
        threads.setdefault(m.thread_id, []).append((m.at, m.no, m.publisher))
    want = {}
    for thread, rows in threads.items():
        seen, base, last = set(), 0, None
        for at, _, publisher in sorted(rows):
            seen.add(publisher)
            if len(seen) > base and (base == 0 or (len(seen) - base) / base >= 0.25):
                base, last = len(seen), at
        want[thread] = (base, last)
    assert found == want
    assert reads._levels(50) == [1, 2, 3, 4, 5, 7, 9, 12, 15, 19, 24, 30, 38, 48, 60]
