"""Source health from kept counts is the walk from event to event; the end of a replay needs no order."""

import datetime as dt
import random

from sigloom.operators.health import BACKOFF
from sigloom.plans import reads
from sigloom.streaming.streams import SourceHealth


def test_batches_are_the_walk(spark, tmp_path):
    rng, t0 = random.Random(4), dt.datetime(2024, 1, 1)
    sources = [1, 2, 3, 4, None]
    rows = [(rng.choice(sources), i, rng.choice(["error", "error", "error", "error", "click", None]), t0 + dt.timedelta(seconds=i // 3)) for i in range(300)]
    rows += [(9, 1000, "error", t0)]
    health, want = SourceHealth(spark, f"file://{tmp_path}/state"), {}
    for number, part in enumerate((rows[:90] + rows[300:], rows[90:93], rows[93:300])):
        names = set()
        for source, _, kind, _ in sorted(part, key=lambda r: (r[3], r[1])):
            failures, level = want.get(source, (0, 0))
            failures = failures + 1 if kind == "error" else 0
            want[source] = failures, max(level if failures else 0, 2 if failures >= 8 else 1 if failures >= 2 else 0)
            names.add(source)
        rng.shuffle(part)
        batch = spark.createDataFrame(part, "user_id bigint, event_id bigint, event_type string, ts timestamp")
        for _ in range(2 if number == 1 else 1):  # a batch may run again
            found = {r.source: (r.failures, r.state, r.wait_minutes) for r in health.step(batch, number).collect()}
        assert found == {s: (want[s][0], ["healthy", "degraded", "quarantined"][want[s][1]], BACKOFF[min(want[s][0], 6)]) for s in names}
    assert {r.source: r.failures for r in health.kept(2).collect()} == {s: f for s, (f, _) in want.items()}


def test_running_sources_order_nothing(spark):
    found = reads.running_sources(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
