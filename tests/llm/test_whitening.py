"""Whitening against exact rational sums, and its error-free steps against fractions."""

from fractions import Fraction

import numpy as np

from sigloom.llm import whitening as W


def exact_covariance(x):
    """By integers alone."""
    n, sums = len(x), x.sum(axis=0)
    moved = [[n * int(v) - int(s) for v, s in zip(row, sums, strict=True)] for row in x]
    d = x.shape[1]
    return [[Fraction(sum(r[i] * r[j] for r in moved), n**3) for j in range(d)] for i in range(d)]


def test_error_free_steps():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=200) * 10.0 ** rng.integers(-9, 9, 200), rng.normal(size=200)
    for pair, want in ((W.two_sum(a, b), lambda x, y: x + y), (W.product(a, b), lambda x, y: x * y)):
        assert all(Fraction(s) + Fraction(e) == want(Fraction(x), Fraction(y)) for s, e, x, y in zip(*pair, a, b, strict=True))


def test_covariance_is_exact_to_twice_the_precision(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, size=(701, 5)) + np.array([10**12, 0, 5, -(10**9), 7])
    want = exact_covariance(x)
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<bigint>")
    for fan in (64, 2):  # merged by the driver at once, or by rounds of tasks
        monkeypatch.setattr(W, "FAN", fan)
        n, sums = W._sums(fit.repartition(7))
        assert (n, sums) == (701, [int(s) for s in x.sum(axis=0)])
        high, low = W.covariance(fit.repartition(7), n, sums)
        for i in range(5):
            for j in range(5):
                assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - want[i][j]) <= abs(want[i][i] * want[j][j]) ** Fraction(1, 2) * 1e-27


def check(rows, found, components=4):
    """Against numpy on exactly centred rows."""
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in good]), axis=0)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)]
    cov = np.array([[float(c) for c in r] for r in exact_covariance(fit)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, len(sums))
    assert len(found) == k * len(good)
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.deviation), []).append(r)
    signs = {}
    for vec_id, x in good:
        deviation = sum((n * int(v) - s) ** 2 for v, s in zip(x, sums, strict=True))
        mine = got[(vec_id, deviation)]
        z = np.array([float(Fraction(int(v)) - Fraction(s, n)) for v, s in zip(x, sums, strict=True)])
        for r in mine:
            c = r.component - 1
            assert r.n == n and abs(r.explained - values[c] / values.sum()) <= 1e-9 * r.explained and r.identity_error < 1e-9
            want = z @ vectors[:, c] / np.sqrt(values[c])
            if abs(want) > 1e-3:
                sign = signs.setdefault(c, np.sign(want) * np.sign(r.whitened))
                assert abs(sign * r.whitened - want) < 1e-7
    assert len(signs) == k


def test_all_vectors_of_a_small_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    check(rows, W.op12_embedding_whitening(spark, "/root/testdata/sf0.001").collect())


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    rows += [rows[0], rows[1], (None, rows[2][1]), (7, None), (8, []), (9, [1.0, None] + [0.0] * 4), (10, [float("nan")] * 6), (11, [float("-inf")] + [0.0] * 5), (12, [-0.0] * 6)]
    rows += [(100 + i, rows[5][1]) for i in range(60)]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id bigint, embedding array<double>, x string, n int")
    check(rows, W.whiten(table).collect())
    assert len(W.whiten(table.limit(0)).collect()) == 0 and W.whiten(table.limit(0)).columns == W.whiten(table).columns
    shorter = table.union(spark.createDataFrame([(1, [1.0, 2.0], "x", 3)], table.schema))
    assert W.whiten(shorter).count() == W.whiten(table).count()


def test_no_variance_and_few_entries(spark):
    make = lambda rows: W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    one = make([(1, [1.0, 2.0, 3.0, 4.0, 5.0])] * 3)
    assert len(one) == 12 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, 0.0, 0.0, 0.0) for r in one)
    line = make([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])
    assert {r.component for r in line} == {1, 2, 3} and all(abs(r.whitened) > 0.1 for r in line if r.component == 1 and r.vec_id != 4)
    assert all(r.whitened == 0 for r in line if r.component > 1)


def test_very_large_entries(spark):
    rows = [(i, [1e300, -1e300 * (i % 2), float(i), 2.0**50 + i / 256]) for i in range(5)]
    found = W.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    most = 2**63 - 1024
    x = [[most, -most * (i % 2), 256 * i, 2**58 + i] for i in range(5)]
    sums = [sum(r[k] for r in x) for k in range(4)]
    want = {i: sum((5 * v - s) ** 2 for v, s in zip(r, sums, strict=True)) for i, r in enumerate(x)}
    assert {r.vec_id: r.deviation for r in found} == {i: v if v < 10**38 else None for i, v in want.items()}
    assert all(np.isfinite(r.whitened) for r in found)
