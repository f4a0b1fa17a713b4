"""Blocks of neighbours: all pairs are found, and few block pairs are compared where vectors are clustered."""

import numpy as np
import pytest

from sigloom.operators import similarity


def clustered(n, clusters, spread, seed=0, d=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(clusters, d))[rng.integers(clusters, size=n)] + rng.normal(size=(n, d)) * spread
    return x / np.linalg.norm(x, axis=1)[:, None]


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>")


@pytest.mark.parametrize("spread, threshold", [(0.05, 0.95), (0.5, 0.6), (3.0, 0.2)])
def test_pairs_and_nearest_are_those_of_all_products(spark, monkeypatch, spread, threshold):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    monkeypatch.setattr(similarity, "PIVOTS", 8)
    monkeypatch.setattr(similarity, "CHUNK", 5)
    x = clustered(300, 9, spread)
    x[7] = 0  # no length
    x[200:230] = x[20]  # copies
    rows = table(spark, x)
    s = x @ x.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= threshold}
    found = [(r.a, r.b) for r in similarity.similar(rows, "id", "v", threshold).collect()]
    assert set(found) == want and len(found) == len(want)
    asked = rows.where("id % 20 = 0")
    best = similarity.best_matches(asked, rows, "id", "v", 3, 0.1).collect()
    np.fill_diagonal(s, -9)
    for i in range(0, 300, 20):
        got = sorted((r.place, r.similarity) for r in best if r.id == i)
        assert np.allclose([v for _, v in got], [v for v in -np.sort(-s[i])[:3] if v >= 0.1])
    before = similarity.best_matches(rows, rows, "id", "v", 2, 0.1, earlier=True).collect()
    for i in range(300):
        got = sorted((r.place, r.similarity) for r in before if r.id == i)
        assert np.allclose([v for _, v in got], [v for v in -np.sort(-s[i, :i])[:2] if v >= 0.1])


def test_block_pairs_grow_less_than_the_square(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    counts = {}
    for n in (512, 2048):
        blocks = similarity._blocks(table(spark, clustered(n, n // 32, 0.05)), "id", "v")
        counts[n] = (blocks.count(), similarity.block_pairs(blocks, blocks, 0.9, twice=False).count())
    (small, few), (large, many) = counts[512], counts[2048]
    assert large >= 3 * small and few < 0.5 * small * small / 2 and many < 9 * few  # all pairs would be 16 times as many
    # A search asks even less once its first round has set a bar.
    rows = table(spark, clustered(2048, 64, 0.05))
    blocks = similarity._blocks(rows, "id", "v")
    pairs = similarity.block_pairs(blocks, blocks, 0.05).checkpoint()
    first = pairs.groupBy("block1").agg({"block2": "min"}).withColumnRenamed("min(block2)", "block2")
    bars = blocks.selectExpr("block as block1", "0.9D as bar")
    assert similarity.later_pairs(pairs, first, bars, 0.05).count() < 0.5 * pairs.count()


def test_bounds_hold():
    rng = np.random.default_rng(3)
    sides, vectors = [], []
    for _ in range(2):
        parts = [clustered(30, 1, s, seed=int(rng.integers(1e6))) * (1 if k % 2 else 2.5) for k, s in enumerate((0.01, 0.1, 0.5, 2.0))]
        means = np.stack([p.mean(axis=0) for p in parts])
        far = np.array([np.linalg.norm(p - m, axis=1).max() for p, m in zip(parts, means)])
        wide = np.array([np.arccos(np.clip(p @ (m / np.linalg.norm(m)), -1, 1)).max() if k % 2 else np.pi for k, (p, m) in enumerate(zip(parts, means))])
        sides.append((means, far, wide))
        vectors.append(parts)
    bound = similarity.bounds(*sides)
    for i in range(4):
        for j in range(4):
            assert (vectors[0][i] @ vectors[1][j].T).max() <= bound[i, j]


def test_empty_tables(spark):
    none, rows = table(spark, np.zeros((0, 3))), table(spark, np.eye(3))
    assert similarity.similar(none, "id", "v", 0.5).count() == 0
    assert similarity.best_matches(none, rows, "id", "v", 2, 0.0).count() == 0 == similarity.best_matches(rows, none, "id", "v", 2, 0.0).count()
