"""Embedding whitening: vectors centred, turned onto the principal axes and scaled to variance one.

The covariance is a compensated sum: outer products of centred vectors are formed and added up as pairs of doubles, a
value and what rounding lost of it, by error-free transformations (TwoSum, and Dekker's product of split factors).  Each
task gives one pair of matrices, and pairs are merged by the same sums in rounds of tasks.  The eigenvectors of the
final matrix come from LAPACK's symmetric solver that numpy's ``eigh`` calls: reduction to a tridiagonal matrix, then
divide and conquer.  They are refined once against the covariance's low part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm.store import drop, keep

#: Steps of an entry's grid: an entry c becomes floor(SCALE * c).
SCALE = 256
COMPONENTS = 4
#: Vectors whose outer products a task forms at once.
ROWS = 64
#: Partial sums that the driver adds up itself; more are merged by rounds of tasks first.
FAN = 64
#: Axes with less than this share of the largest variance have none that could be scaled.
LEAST_SHARE = 1e-13

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: np.ndarray) -> Pair:
    """Two halves of 26 bits each that add up to ``a``."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def add(one: Pair, other: Pair) -> Pair:
    """The sum of two pairs, as a pair."""
    s, e = two_sum(one[0], other[0])
    return two_sum(s, e + (one[1] + other[1]))


def product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b and its rounding error, exactly (entries of moderate size)."""
    p = a * b
    (ah, al), (bh, bl) = split(a), split(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def outer_sums(high: np.ndarray, low: np.ndarray) -> Pair:
    """The sum of z z' over rows z = high + low, for the upper triangle of dimensions."""
    d = high.shape[1]
    one, two = np.triu_indices(d)
    halves = split(high)
    total = (np.zeros(len(one)), np.zeros(len(one)))
    for at in range(0, len(high), ROWS):
        z, y, (zh, zl) = high[at : at + ROWS], low[at : at + ROWS], (h[at : at + ROWS] for h in halves)
        a, b = z[:, one], z[:, two]
        p = a * b
        ah, bh, al, bl = zh[:, one], zh[:, two], zl[:, one], zl[:, two]
        e = ((ah * bh - p) + ah * bl + al * bh) + al * bl + (a * y[:, two] + y[:, one] * b)
        while len(p) > 1:  # in halves, so that a sum of rows costs a few passes over all dimensions at once
            half = len(p) // 2
            s, lost = two_sum(p[:half], p[half : 2 * half])
            rest = e[:half] + e[half : 2 * half] + lost
            p, e = (np.concatenate([s, p[2 * half :]]), np.concatenate([rest, e[2 * half :]])) if len(p) % 2 else (s, rest)
        total = add(total, (p[0], e[0]))
    return total


@dataclass
class Whitening:
    """What the fit gives; ``axes`` are rows, and ``scale`` is 0 for axes without variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    total: float
    axes: np.ndarray
    scale: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> Pair:
        return centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centred(x)
        return (high @ self.axes.T + low @ self.axes.T) * self.scale


def means_of(n: int, sums: list[int]) -> Pair:
    """The sums over n, as pairs."""
    exact = [Fraction(s, n) for s in sums]
    high = [float(m) for m in exact]
    return np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(exact, high, strict=True)])


def centred(x: np.ndarray, n: int, sums: list[int]) -> Pair:
    """x - S / n as pairs; entries beyond 53 bits keep their lowest bits too."""
    high, low = means_of(n, sums)
    whole = x.astype(np.float64)
    rest = (x - np.clip(whole, -(2.0**63), 2.0**63 - 1024).astype(np.int64)).astype(np.float64)
    s, e = two_sum(whole, -high[None, :])
    return two_sum(s, e + (rest - low[None, :]))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - S)^2, exactly."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums), default=0)
    if len(sums) * most * most < 2**63:
        moved = x * n - np.array(sums, np.int64)[None, :]
        return (moved * moved).sum(axis=1).tolist()
    return [sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


def on_grid(docs: DataFrame, vector: str, scale: int = SCALE) -> Column:
    """floor(scale * entry) of each entry as longs; null where the vector is null, empty or holds null or non-finite
    entries.  Entries too large for a long are the nearest long."""
    v = F.col(vector)
    if not isinstance(docs.schema[vector].dataType, T.ArrayType):
        raise TypeError(f"{vector} isn't an array")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    most = float(2**63 - 1024)
    within = lambda c: F.greatest(F.lit(-most), F.least(F.lit(most), c.cast("double") * scale))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, F.transform(v, lambda c: F.floor(within(c))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and each dimension's exact sum; a row for each task and dimension is all that is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                n, high, low = n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            d = len(high)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = sorted(fit.mapInArrow(run, "dim bigint, n bigint, high bigint, low bigint").groupBy("dim").agg(total("n"), total("high"), total("low")).collect())
    return (int(rows[0].n), [(int(r.high) << 32) + int(r.low) for r in rows]) if rows else (0, [])


def _packed(pair: Pair) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.astype("<f8").tobytes()], pa.binary()) for v in pair], names=["high", "low"])


def _unpacked(high: bytes, low: bytes) -> Pair:
    return np.frombuffer(high, "<f8"), np.frombuffer(low, "<f8")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Pair | None = None
    for batch in batches:
        for high, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = _unpacked(high, low)
            total = found if total is None else add(total, found)
    if total is not None:
        yield _packed(total)


def covariance(fit: DataFrame, n: int, sums: list[int]) -> Pair:
    """The covariance (divisor n) of the rows of ``fit`` (x) about S / n, as a pair of matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Pair | None = None
        for batch in batches:
            if batch.num_rows:
                found = outer_sums(*centred(_matrix(batch.column(0)), n, sums))
                total = found if total is None else add(total, found)
        if total is not None:
            yield _packed(total)

    schema = "high binary, low binary"
    parts = keep(fit.mapInArrow(run, schema), "outer-sums")
    count = parts.count()
    while count > FAN:
        fewer = max(FAN, int(np.ceil(count**0.5)))
        merged = keep(parts.repartition(fewer).mapInArrow(_merge, schema), "outer-sums")
        drop(parts)
        parts, before, count = merged, count, merged.count()
        if count >= before:
            break
    total = None
    for r in parts.toLocalIterator():
        found = _unpacked(bytes(r.high), bytes(r.low))
        total = found if total is None else add(total, found)
    drop(parts)
    high = total[0] / n
    # What the division lost, from the exact product of the quotient and n.
    p, e = product(high, np.float64(n))
    low = (((total[0] - p) - e) + total[1]) / n
    d = len(sums)
    out = []
    for values in (high, low):
        matrix = np.zeros((d, d))
        matrix[np.triu_indices(d)] = values
        out.append(matrix + np.triu(matrix, 1).T)
    return out[0], out[1]


def principal_axes(high: np.ndarray, low: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``count`` eigenvalues, falling, and their unit eigenvectors as rows."""
    values, vectors = np.linalg.eigh(high)
    values, vectors = values[::-1], vectors[:, ::-1]
    # One step of first order with the low part and what the solver left.
    rest = vectors.T @ (high @ vectors - vectors * values + low @ vectors)
    gaps = values[None, :] - values[:, None]
    safe = np.abs(gaps) > 1e-8 * max(abs(values[0]), 1e-300)
    turn = np.where(safe, rest / np.where(safe, gaps, 1.0), 0.0)
    refined = vectors + vectors @ turn
    refined /= np.linalg.norm(refined, axis=0)
    return (values + np.diag(rest))[:count], refined.T[:count]


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """From every row of ``fit`` (x: longs, one length); None where there are none."""
    n, sums = _sums(fit)
    if not n:
        return None
    high, low = covariance(fit, n, sums)
    variances, axes = principal_axes(high, low, min(components, len(sums)))
    scaled = variances > max(LEAST_SHARE * variances[0], 0.0)
    scale = np.where(scaled, 1 / np.sqrt(np.where(scaled, variances, 1.0)), 0.0)
    model = Whitening(n, sums, np.maximum(variances, 0.0), float(np.trace(high)), axes, scale, 0.0)
    k = len(scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                w = model.project(_matrix(batch.column(0)))
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    total = np.zeros((k + 1) * k)
    for cell, v in fit.mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v")).collect():
        total[cell] = v
    total = total.reshape(k + 1, k) / n
    found = total[:k] - np.outer(total[k], total[k])
    some = scale > 0
    model.identity_error = float(np.abs(found[np.ix_(some, some)] - np.eye(int(some.sum()))).max(initial=0.0))
    return model


RESULT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each usable row of ``vectors`` (vec_id, embedding) and component: n, deviation, whitened, explained and
    identity_error.

    Entries are put on a grid (``on_grid``); the fit takes each different vector once.  Rows whose vector is null, empty
    or holds null or non-finite entries are left out, and so are those of another length than the commonest one (the
    shortest of equally common ones).  Repeated rows are whitened each; a null vec_id stays null; other columns are left
    out, whatever their names.  Axes without variance, as where all vectors are equal, give 0; vectors shorter than
    ``components`` have as many components as entries.  An empty table gives no rows.  A deviation of more than 38
    digits is null.
    """
    spark = vectors.sparkSession
    placed = vectors.select("vec_id", on_grid(vectors, "embedding").alias("x")).where("x is not null")
    lengths = placed.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], RESULT)
    placed = placed.where(F.size("x") == lengths[0].d)
    fit = keep(placed.select("x").distinct(), "fit-list")
    model = fit_whitening(fit, components)
    drop(fit)
    k = len(model.scale)
    explained = model.variances / model.total if model.total > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            rows = len(x)
            exact = [v if v < 10**38 else None for v in deviations(x, model.n, model.sums)]
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, model.n)),
                pa.array(exact, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(model.project(x).ravel()),
                pa.array(np.tile(explained, rows)),
                pa.array(np.full(rows * k, model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])

    return placed.mapInArrow(run, RESULT)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``.  A deviation that a long doesn't hold, from about 10^8 different vectors on, is null; its
    exact value stands in deviation_exact."""
    found = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error", F.col("deviation").alias("deviation_exact"))
