"""Vectors as arrays: products, centring and the hashing embedding, all as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The vector over its length; zero stays zero.  The vector and its length are bound once, as a lambda that took
    them from an expression would work them out again for every place."""
    bound = F.transform(F.array(a), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    over = F.transform(bound, lambda b: F.when(b["n"] > 0, F.transform(b["v"], lambda x: x.cast("double") / b["n"])).otherwise(b["v"].cast("array<double>")))
    return F.get(over, F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, of different sizes or of no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def _place_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, s, n: sum and count of each place over all vectors of a task; nulls count for nothing."""
    sums, counts = np.zeros(0), np.zeros(0)
    for batch in batches:
        vectors = batch.column(0).drop_null()
        lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        values = vectors.flatten()
        known = values.is_valid().to_numpy(zero_copy_only=False)
        place, values = place[known], values.drop_null().to_numpy(zero_copy_only=False).astype(np.float64)
        size = max(len(sums), int(lengths.max(initial=0)))
        sums = np.pad(sums, (0, size - len(sums))) + np.bincount(place, weights=values, minlength=size)
        counts = np.pad(counts, (0, size - len(counts))) + np.bincount(place, minlength=size)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some]), pa.array(counts[some].astype(np.int64))], names=["i", "s", "n"])


def mean_vector(rows: DataFrame, column: str, *keys: str) -> DataFrame:
    """The mean of each place, by keys: sums of each place before any shuffle, then an array in order."""
    if keys:
        cells = rows.select(*keys, F.posexplode(column).alias("i", "v")).groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    else:
        sums = rows.select(column).mapInArrow(_place_sums, "i int, s double, n bigint")
        cells = sums.groupBy("i").agg((F.sum("s") / F.sum("n")).alias("v"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"])
    return cells.groupBy(*keys).agg(ordered.alias("mean"))


def centred(a: Column, mean: Column) -> Column:
    return F.zip_with(a, mean, lambda x, m: x.cast("double") - m)


def features(a: Column, mean: Column) -> Column:
    """The vector less the mean, over its length and a guard against zero; bound once, as in ``unit``."""
    bound = F.transform(F.array(centred(a, mean)), lambda v: F.struct(v.alias("v"), (norm(v) + F.lit(1e-9)).alias("n")))
    return F.get(F.transform(bound, lambda b: F.transform(b["v"], lambda x: x / b["n"])), F.lit(0))
