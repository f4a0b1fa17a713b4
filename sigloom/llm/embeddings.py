"""Embedding near-dedup: all vectors against all, in tiles ordered by the leading principal component.

Vectors are turned onto the principal axes of all of them, which keeps cosines.  Tiles follow the first coordinate, so a
tile meets only those whose first coordinates are near enough.  Inside a pair of tiles the leading coordinates are
multiplied first; the product of the norms of what is left bounds the rest.  Pairs go on, some coordinates more at a
time, only while the bound can reach the threshold.  What comes to the end is settled in double precision from the
vectors themselves.

A task returns, for each vector, how many vectors of the other tile it links with, and a spanning forest of the links:
pairs inside a group of copies are counted but never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.components import components
from sigloom.llm.store import keep

#: Vectors in a tile and in the part of it that is multiplied at once; leading coordinates of the first product.
TILE, PART, LEADING = 4096, 256, 16
#: What single precision may lose in the first product.
SLACK = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one.  Rows are first scaled by a power of two, which is exact, so that squares neither over- nor
    underflow."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.square(x).sum(axis=1))[:, None]


def principal_axes(classes: DataFrame, size: int) -> np.ndarray:
    """Eigenvectors of the sum of outer products of all unit vectors, the largest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            unit = _unit(_matrix(batch.column(0)))
            total += unit.T @ unit
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["cell", "v"])

    total = np.zeros(size * size)
    for cell, v in classes.select("vector").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v")).collect():
        total[cell] = v
    _, vectors = np.linalg.eigh(total.reshape(size, size))
    return np.ascontiguousarray(vectors[:, ::-1])


class Forest:
    """Union by smallest place."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = sorted((self.find(x), self.find(y)))
        self.parent[y] = x
        return x != y


def _spanning(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) that join whatever the links of a block join, one fewer than there are nodes at most."""
    n_rows, n_columns = links.shape
    out: list[tuple[int, int]] = []
    seen_columns = np.zeros(n_columns, bool)
    left = links.any(axis=1)
    while left.any():
        row = int(np.argmax(left))
        left[row] = False
        rows = [row]
        while rows:
            row = rows.pop()
            new = np.flatnonzero(links[row] & ~seen_columns)
            seen_columns[new] = True
            out += [(row, int(c)) for c in new]
            if len(new):
                reached = np.flatnonzero(links[:, new].any(axis=1) & left)
                left[reached] = False
                for r in reached.tolist():
                    out.append((r, int(new[np.argmax(links[r, new])])))
                rows += reached.tolist()
    return out


def compare(x: np.ndarray, y: np.ndarray | None, x_weights: np.ndarray, y_weights: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weighted link counts of the rows of x and of y, and links that span what they join (places in x, then y).

    With y None, x meets itself and each pair counts once for both.
    """
    alone = y is None
    unit_x = _unit(x)
    unit_y = unit_x if alone else _unit(y)
    k = min(LEADING, axes.shape[1])

    steps = list(range(k, axes.shape[1], LEADING))

    def leading(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The leading coordinates with the norm of the rest, all coordinates, and the norms of what follows each step."""
        turned = unit @ axes
        squares = np.cumsum(np.square(turned)[:, ::-1], axis=1)[:, ::-1]
        rests = np.sqrt(np.maximum(squares[:, steps], 0)) if steps else np.zeros((len(unit), 1))
        return np.concatenate([turned[:, :k], rests[:, :1]], axis=1).astype(np.float32), turned, rests

    lead_x, turned_x, rest_x = leading(unit_x)
    lead_y, turned_y, rest_y = (lead_x, turned_x, rest_x) if alone else leading(unit_y)
    n_x, n_y = np.zeros(len(unit_x), np.int64), np.zeros(len(unit_y), np.int64)
    forest, edges = Forest(len(unit_x) + len(unit_y)), []
    for at in range(0, len(unit_x), PART):
        from_ = at if alone else 0
        may = lead_x[at : at + PART] @ lead_y[from_:].T >= threshold - SLACK
        if alone:
            may &= np.arange(from_, len(unit_y))[None, :] > np.arange(at, min(at + PART, len(unit_x)))[:, None]
        n_may = int(np.count_nonzero(may))
        if not n_may:
            continue
        if n_may > may.size // 64:
            may &= unit_x[at : at + PART] @ unit_y[from_:].T >= threshold
        else:
            i, j = np.nonzero(may)
            may[i, j] = False
            product = np.einsum("ij,ij->i", turned_x[at + i, :k], turned_y[from_ + j, :k])
            for n, step in enumerate(steps[1:], 1):
                part = slice(steps[n - 1], step)
                product += np.einsum("ij,ij->i", turned_x[at + i, part], turned_y[from_ + j, part])
                on = product + rest_x[at + i, n] * rest_y[from_ + j, n] >= threshold - SLACK
                i, j, product = i[on], j[on], product[on]
            may[i, j] = np.einsum("ij,ij->i", unit_x[at + i], unit_y[from_ + j]) >= threshold
        n_x[at : at + PART] += may @ y_weights[from_:]
        n_y[from_:] += x_weights[at : at + PART] @ may
        for i, j in _spanning(may):
            a, b = at + i, (0 if alone else len(unit_x)) + from_ + j
            if forest.join(a, b):
                edges.append((a, b))
    if alone:
        n_x = n_x + n_y
    return n_x, n_y, edges


def _tiles(classes: DataFrame, axes: np.ndarray) -> tuple[DataFrame, list[float]]:
    """A row for each tile, in order of the first coordinate, and the edges between stretches of it."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_unit(_matrix(batch.column(2))) @ axes[:, 0])], names=[*batch.schema.names, "pc"])

    found = keep(classes.mapInArrow(first, "rep bigint, n bigint, vector array<double>, pc double"), "turned")
    n = -(-found.count() // TILE)
    edges = sorted(set(found.approxQuantile("pc", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    stretch = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e <= F.col("pc"))) if edges else F.lit(0)
    rows = found.withColumn("stretch", stretch)
    sizes = rows.groupBy("stretch").agg(F.greatest(F.lit(1), F.round(F.count("*") / TILE)).cast("int").alias("parts"))
    rows = rows.join(sizes, "stretch").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["vector"].to_numpy())
        return pd.DataFrame({"stretch": [key[0]], "part": [key[1]], "reps": [rows["rep"].to_numpy().tobytes()], "weights": [rows["n"].to_numpy().tobytes()], "x": [x.tobytes()]})

    blocks = rows.groupBy("stretch", "part").applyInPandas(block, "stretch int, part int, reps binary, weights binary, x binary")
    return keep(blocks, "tiles"), edges


def _partners(stretch: int, edges: list[float], reach: float) -> int:
    """The last stretch that one must meet: first coordinates further apart than ``reach`` can't link."""
    if stretch >= len(edges):
        return stretch
    return int(np.searchsorted(edges, edges[stretch] + reach, side="right"))


def _linked(classes: DataFrame, size: int, threshold: float) -> DataFrame:
    """kind 0: a has b linked vectors more; kind 1: a links with b."""
    axes = principal_axes(classes, size)
    tiles, edges = _tiles(classes, axes)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    last = F.lit([_partners(k, edges, reach) for k in range(len(edges) + 1)])
    keys = tiles.select("stretch", "part")
    asks = keys.select("stretch", "part", F.explode(F.sequence("stretch", F.get(last, F.col("stretch")))).alias("other"))
    pairs = asks.join(keys.select(F.col("stretch").alias("other"), F.col("part").alias("other_part")), "other")
    pairs = pairs.where("other > stretch or other_part >= part")
    one = tiles.select("stretch", "part", "reps", "weights", "x")
    two = tiles.select(F.col("stretch").alias("other"), F.col("part").alias("other_part"), F.col("reps").alias("reps2"), F.col("weights").alias("weights2"), F.col("x").alias("x2"))
    both = pairs.join(one, ["stretch", "part"]).join(two, ["other", "other_part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                alone = (row["stretch"], row["part"]) == (row["other"], row["other_part"])
                reps, reps2 = (np.frombuffer(row[c], np.int64) for c in ("reps", "reps2"))
                weights, weights2 = (np.frombuffer(row[c], np.int64) for c in ("weights", "weights2"))
                x, y = (np.frombuffer(row[c], np.float64).reshape(-1, size) for c in ("x", "x2"))
                n_x, n_y, found = compare(x, None if alone else y, weights, weights2, axes, threshold)
                names = np.concatenate([reps, reps if alone else reps2])
                # Alone, the second half of the places stands for the same vectors.
                pairs = np.array([(names[a], names[b]) for a, b in found], np.int64).reshape(-1, 2)
                counts = np.stack([reps, n_x], axis=1) if alone else np.concatenate([np.stack([reps, n_x], axis=1), np.stack([reps2, n_y], axis=1)])
                counts = counts[counts[:, 1] > 0]
                rows = np.concatenate([counts, pairs])
                kind = np.repeat([0, 1], [len(counts), len(pairs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["kind", "a", "b"])

    columns = ["stretch", "part", "other", "other_part", "reps", "weights", "x", "reps2", "weights2", "x2"]
    return both.select(*columns).mapInArrow(run, "kind int, a bigint, b bigint")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id (the smallest vec_id reachable by links) and kept, for every row.

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing, as do rows with a null
    vec_id (whose component is null).  Vectors of different sizes don't link.  Rows that share a vec_id are vectors of
    their own under one name.  An empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col("vec_id").isNotNull() & F.coalesce(F.forall("vector", fine) & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.transform("vector", lambda v: v + 0.0)))
    classes = keep(rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    found = None
    for r in classes.select(F.size("vector").alias("size")).distinct().collect():
        part = _linked(classes.where(F.size("vector") == r["size"]).select("rep", "n", "vector"), r["size"], threshold)
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = keep(found, "links")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    parts = components(found.where("kind = 1").select("a", "b"))
    named = classes.join(counts, "rep", "left").join(parts, F.col("rep") == F.col("node"), "left")
    named = named.select("vector", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    joined = rows.join(named, "vector", "left")
    component = F.coalesce("component", "vec_id")
    component = F.when(F.col("vec_id").isNotNull(), component)
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``embeddings``, whatever their labels."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
