"""Pairs of vectors by blocks of neighbours, of which only those are compared that may hold a pair.

Vectors are dealt to the nearest of some pivots and cut into blocks there.  A block knows its mean and how far its
vectors are from it, as a distance and, for vectors of unit length, as an angle; that bounds the products of two blocks.
The bounds of all block pairs come from these few numbers by chunks of blocks, and matrices travel for the pairs that
are left only.  Searches take two rounds: each block meets its most promising block first, and what it has found there
is the bar for all others.

Block pairs are dealt as cells of a grid: a task holds the matrices of one strip of blocks and lets those of another
pass by, so a matrix travels once for each strip that it meets, not once for each block, and a search's finds leave the
task when a cell is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.sources.folders import ready_checkpoints

#: Vectors of a block; pivots at most, which the driver holds; blocks of a chunk.
BLOCK, PIVOTS, CHUNK = 2048, 1024, 1024
#: Bytes of matrices in a strip, about; strips of a side at least; rows of products that a task makes at once.
STRIP, STRIPS, ROWS = 64_000_000, 6, 256
#: What rounding may take from a bound.
SLACK = 1e-9

BLOCKS = "block bigint, ids binary, x binary, size int, mean binary, far double, wide double"


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _pivots(rows: DataFrame, n: int) -> np.ndarray:
    """As many vectors as blocks are needed, PIVOTS at most, by a hash of their keys."""
    picked = rows.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(min(n, PIVOTS)).collect()
    return np.array([r.v for r in picked], np.float64)


def _blocks(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """A row for each block: ids, one matrix, the mean, the largest distance and the largest angle from it."""
    ready_checkpoints(rows.sparkSession)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n = -(-rows.count() // BLOCK)
    pivots = _pivots(rows, max(1, n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = np.argmax(_matrix(batch.column(1), pivots.shape[1]) @ pivots.T, axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["id", "v", "cell"])

    def pack(block: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x = np.stack(part["v"].to_numpy()).astype(np.float64)
        mean = x.mean(axis=0)
        length = np.linalg.norm(mean)
        unit = bool((np.abs(np.linalg.norm(x, axis=1) - 1) < 1e-7).all()) and length > 0
        wide = float(np.arccos(np.clip(x @ (mean / length), -1, 1)).max()) if unit else np.pi
        far = float(np.linalg.norm(x - mean, axis=1).max())
        return pd.DataFrame({"block": [block[0]], "ids": [part["id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "size": [x.shape[1]], "mean": [mean.tobytes()], "far": [far], "wide": [wide]})

    dealt = rows.mapInArrow(deal, "id bigint, v array<double>, cell bigint") if n else rows.withColumn("cell", F.lit(0).cast("bigint"))
    # At most PIVOTS cells; one that holds very many vectors is cut into as many blocks as it takes.
    cells = F.broadcast(dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts")))
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts"))
    dealt = dealt.join(cells, "cell").select("id", "v", (F.shiftleft("cell", 32) + part).alias("block"))
    return dealt.groupBy("block").applyInPandas(pack, BLOCKS).checkpoint()


def _chunks(blocks: DataFrame, side: str) -> tuple[DataFrame, int]:
    n = max(1, -(-blocks.count() // CHUNK))

    def pack(chunk: tuple, part: pd.DataFrame) -> pd.DataFrame:
        means = np.stack([np.frombuffer(m, np.float64) for m in part["mean"]])
        columns = {"blocks": part["block"].to_numpy(np.int64), "means": means, "far": part["far"].to_numpy(float), "wide": part["wide"].to_numpy(float)}
        return pd.DataFrame({"chunk": [chunk[0]]} | {k: [np.ascontiguousarray(v).tobytes()] for k, v in columns.items()})

    dealt = blocks.select("block", "mean", "far", "wide", F.pmod(F.xxhash64("block"), F.lit(n)).cast("int").alias("chunk"))
    packed = dealt.groupBy("chunk").applyInPandas(pack, "chunk int, blocks binary, means binary, far binary, wide binary")
    return packed.select(*[F.col(c).alias(f"{c}{side}") for c in packed.columns]), n


def bounds(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> np.ndarray:
    """No product of a vector of a block of ``one`` with one of a block of ``two`` (means, far, wide) is larger."""
    (m, far1, wide1), (w, far2, wide2) = one, two
    long1, long2 = np.linalg.norm(m, axis=1), np.linalg.norm(w, axis=1)
    product = m @ w.T
    by_distance = product + long1[:, None] * far2 + far1[:, None] * long2 + far1[:, None] * far2
    cosine = np.clip(product / np.maximum(long1[:, None] * long2, 1e-300), -1, 1)
    by_angle = np.cos(np.maximum(np.arccos(cosine) - wide1[:, None] - wide2, 0))
    both_unit = (wide1[:, None] < np.pi) & (wide2 < np.pi)
    return np.where(both_unit, np.minimum(by_distance, by_angle), by_distance) + SLACK


def block_pairs(asked: DataFrame, blocks: DataFrame, threshold: float, twice: bool = True) -> DataFrame:
    """block1, block2 and bound of the block pairs that may hold a product from ``threshold`` up; without ``twice`` a pair
    of blocks of one table comes once."""
    one, _ = _chunks(asked, "1")
    two, n = _chunks(blocks, "2")
    both = one.withColumn("chunk2", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(two, "chunk2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name, kind=np.float64: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: E731, B023
                side = lambda s: (get(f"means{s}").reshape(len(get(f"far{s}")), -1), get(f"far{s}"), get(f"wide{s}"))  # noqa: E731, B023
                first, second = get("blocks1", np.int64), get("blocks2", np.int64)
                bound = bounds(side("1"), side("2"))
                i, j = np.nonzero((bound >= threshold) & (twice | (first[:, None] <= second)))
                yield pa.RecordBatch.from_arrays([pa.array(first[i]), pa.array(second[j]), pa.array(bound[i, j])], names=["block1", "block2", "bound"])

    return both.mapInArrow(run, "block1 bigint, block2 bigint, bound double")


def _strips(blocks: DataFrame) -> int:
    n, size = blocks.agg(F.count("*"), F.sum(F.octet_length("x"))).first()
    return max(min(n, STRIPS), -(-(size or 1) // STRIP))


def _cells(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, twice: bool = True) -> DataFrame:
    """The matrices of block pairs by cell, in order: those that a task holds (side 0), then those that pass by (side 1)
    with the held blocks that each meets.  Without ``twice`` the strip of the lower number is held."""
    n1 = _strips(asked)
    n2 = n1 if asked is blocks else _strips(blocks)
    strip = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    placed = pairs.select("block1", "block2", strip("block1", n1).alias("s1"), strip("block2", n2).alias("s2"))
    if not twice:
        swap = F.col("s1") > F.col("s2")
        turned = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
        placed = placed.select(turned("block1", "block2").alias("block1"), turned("block2", "block1").alias("block2"), turned("s1", "s2").alias("s1"), turned("s2", "s1").alias("s2"))
    placed = placed.select((F.col("s1") * n2 + F.col("s2")).alias("cell"), "block1", "block2")
    held = placed.select("cell", F.lit(0).alias("side"), F.col("block1").alias("block"), F.lit(None).cast("array<bigint>").alias("meets")).distinct()
    passing = placed.groupBy("cell", F.col("block2").alias("block")).agg(F.collect_list("block1").alias("meets"))  # as many as a strip has blocks
    passing = passing.select("cell", F.lit(1).alias("side"), "block", "meets")
    found = [side.join(matrices.select("block", "ids", "x", "size"), "block") for side, matrices in ((held, asked), (passing, blocks))]
    # A task takes one cell: cells dealt by hash meet in tasks, which then get all their matrices in one Arrow batch.
    return found[0].union(found[1]).repartitionById(n1 * n2, "cell").sortWithinPartitions("cell", "side", "block")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """Cell, block numbers, ids and matrices of one block pair after the other."""
    cell, held = None, {}
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name: batch.column(name)[k]  # noqa: E731, B023
            number, block = get("cell").as_py(), get("block").as_py()
            if number != cell:
                cell, held = number, {}
            ids, x = np.frombuffer(get("ids").as_buffer(), np.int64), np.frombuffer(get("x").as_buffer(), np.float64).reshape(-1, get("size").as_py())
            if get("side").as_py() == 0:
                held[block] = ids.copy(), x.copy()  # the batch may go
            else:
                for other in get("meets").as_py():
                    yield cell, other, block, held[other], (ids, x)


def similar(rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """a < b and similarity of all vectors whose product reaches the threshold."""
    blocks = _blocks(rows, key, vector)
    pairs = block_pairs(blocks, blocks, threshold, twice=False).checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block1, block2, (ids1, x1), (ids2, x2) in _meetings(batches):
            for at in range(0, len(ids1), ROWS):
                s, ids = x1[at : at + ROWS] @ x2.T, ids1[at : at + ROWS]
                i, j = np.nonzero((s >= threshold) & ((ids[:, None] < ids2[None, :]) | (block1 != block2)))
                if len(i):
                    a, b = np.minimum(ids[i], ids2[j]), np.maximum(ids[i], ids2[j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s[i, j])], names=["a", "b", "similarity"])

    return _cells(pairs, blocks, blocks, twice=False).mapInArrow(run, "a bigint, b bigint, similarity double")


def later_pairs(pairs: DataFrame, first: DataFrame, bars: DataFrame, floor: float) -> DataFrame:
    """The block pairs that may still better what their block1 has found: not those of ``first``, nor below its bar."""
    left = pairs.join(first.select("block1", "block2"), ["block1", "block2"], "left_anti").join(bars, "block1", "left")
    return left.where(F.col("bound") >= F.coalesce("bar", F.lit(floor))).select("block1", "block2", "bound")


def _nearest(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray], k: int, earlier: bool, digits: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The k largest products of each vector of ``one`` with those of ``two`` and the ids of these, the least first among
    equals (ids of ``two`` ascend); -inf where there are fewer."""
    (ids1, x1), (ids2, x2) = one, two
    best, other = np.full((len(ids1), k), -np.inf), np.zeros((len(ids1), k), np.int64)
    for at in range(0, len(ids1), ROWS):
        s, ids = x1[at : at + ROWS] @ x2.T, ids1[at : at + ROWS, None]
        s[(ids <= ids2) if earlier else (ids == ids2)] = -np.inf
        np.fmax(s, -np.inf, out=s)
        if digits is not None:
            np.round(s, digits, out=s)
        row = np.arange(len(s))
        for place in range(k):
            j = s.argmax(axis=1)
            best[at + row, place], other[at + row, place] = s[row, j], ids2[j]
            s[row, j] = -np.inf
    return best, other


def best_matches(asked: DataFrame, rows: DataFrame, key: str, vector: str, k: int, floor: float, earlier: bool = False, digits: int | None = None) -> DataFrame:
    """The k nearest rows of each asked vector from ``floor`` up, other than itself or, with ``earlier``, of a smaller key
    only: the best k of every cell, then of them all.  Equally near ones come by key; with ``digits`` products are
    rounded before anything is compared, so that rounding errors don't settle which of two is nearer."""
    asks = _blocks(asked, key, vector)
    blocks = asks if asked is rows else _blocks(rows, key, vector)
    pairs = block_pairs(asks, blocks, floor).checkpoint()
    schema = "block1 bigint, id bigint, other bigint, similarity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, found = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for block1, (ids1, best, other) in found.items():
                i, j = np.nonzero(best >= floor)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), block1)), pa.array(ids1[i]), pa.array(other[i, j]), pa.array(best[i, j])], names=["block1", "id", "other", "similarity"])

        for number, block1, _, one, two in _meetings(batches):
            if number != cell:
                yield from done()
                cell, found = number, {}
            best, other = _nearest(one, two, k, earlier, digits)
            if block1 in found:
                best, other = np.hstack([found[block1][1], best]), np.hstack([found[block1][2], other])
                order = np.lexsort((other, -best), axis=1)[:, :k]
                best, other = np.take_along_axis(best, order, axis=1), np.take_along_axis(other, order, axis=1)
            found[block1] = one[0], best, other
        yield from done()

    def compared(these: DataFrame) -> DataFrame:
        return _cells(these, asks, blocks).mapInArrow(run, schema)

    first = pairs.groupBy("block1").agg(F.max_by("block2", F.struct("bound", "block2")).alias("block2"))
    found = compared(first).checkpoint()
    # A block's bar: the worst k-th best of its vectors, where all of them have found k.
    kth = found.groupBy("block1", "id").agg(F.count("*").alias("n"), F.min("similarity").alias("kth")).where(F.col("n") >= k)
    sizes = asks.select(F.col("block").alias("block1"), (F.octet_length("ids") / 8).alias("vectors"))
    bars = kth.groupBy("block1").agg(F.count("*").alias("full"), F.min("kth").alias("bar")).join(sizes, "block1").where(F.col("full") == F.col("vectors")).select("block1", "bar")
    found = found.union(compared(later_pairs(pairs, first, bars, floor).checkpoint()))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return found.drop("block1").withColumn("place", place).where(F.col("place") <= k).withColumnRenamed("id", key)
