"""Targets of many labels are fitted by all tasks, with the results of one."""

import numpy as np
from pyspark.sql import functions as F

from sigloom.operators import probe


def test_spread_fits_are_those_of_one_task(spark, monkeypatch):
    monkeypatch.setattr(probe, "ALONE", 100)
    monkeypatch.setattr(probe, "BLOCK", 64)
    monkeypatch.setattr(probe, "STEPS", 15)
    draw = np.random.default_rng(2)
    rows = []
    for target, spread in ((1, 0.6), (2, 3.0)):
        for i in range(400):
            y = int(draw.random() < 0.3)
            x = draw.normal(0, spread, 6) + (0.5 if y else -0.5)
            rows.append((target, i, y, x.tolist()))
    rows += [(3, i, int(i == 7), [float(i)] * 6) for i in range(150)]  # too few positives
    table = spark.createDataFrame(rows, "target bigint, id bigint, y int, x array<double>")
    seen = []
    monkeypatch.setattr(probe, "_train_alone", lambda folded, whole=probe._train_alone: seen.append(folded.count()) or whole(folded))
    found = {r.target: r for r in probe.train_targets(table).collect()}
    assert seen == [0]
    folds = {r.id: r.fold for r in table.select("id", F.pmod(F.xxhash64("id"), F.lit(probe.FOLDS)).alias("fold")).distinct().collect()}
    for target in (1, 2, 3):
        mine = [r for r in rows if r[0] == target]
        x, y, fold = np.array([r[3] for r in mine]), np.array([float(r[2]) for r in mine]), np.array([folds[r[1]] for r in mine])
        w, b = probe.fit(x, y)
        r = found[target]
        assert r.n == len(mine) and np.allclose(r.weights, w) and np.isclose(r.bias, b)
        if target == 3:
            assert np.isnan(r.auc) and not r.enabled and (r.add_t, r.veto_t) == (0.99, 0.0)
            continue
        scores = np.zeros(len(y))
        for k in range(probe.FOLDS):
            wk, bk = probe.fit(x[fold != k], y[fold != k])
            scores[fold == k] = x[fold == k] @ wk + bk
        assert np.isclose(r.auc, probe.area(scores, y)) and r.enabled == (r.auc >= 0.9)
        assert np.allclose((r.add_t, r.veto_t), probe.thresholds(1 / (1 + np.exp(-scores)), y))
