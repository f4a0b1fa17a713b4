"""Best-fit packing of documents into sequences by a grouping genetic algorithm on islands.

Pieces are dealt out by hash into groups of bounded size.  Several islands evolve packings of each group; between
epochs the best packing of every island moves to its neighbour.  A chromosome is a list of bins: crossover injects
whole well-filled bins of one parent into the other, takes out the bins that would hold a piece twice, and puts the
displaced pieces where they fit best.  The loosely filled bins of all groups are then packed anew together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.store import drop, keep
from sigloom.llm.textbatch import chunks
from sigloom.llm.tokens import default_path, tokenizer, with_end

#: Pieces of a group, on average; islands of each group; epochs with migration between them.
GROUP, ISLANDS, EPOCHS = 16_384, 2, 2
POPULATION, GENERATIONS = 6, 12
#: Bins filled less than this are packed anew across groups.
LOOSE = 0.97
#: Bins of a group, at most: sequence ids are made of the group, the bin and the pass.
MOST_BINS = 1 << 20

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: ``deal`` is a random number that puts a piece into its groups, so that rows alike don't all meet in one.
DEALT = PIECES + ", deal bigint"


def cut_pieces(docs: DataFrame, capacity: int, tokenizer_path: str, end_id: int) -> DataFrame:
    """The pieces of every whole text with its end id; only documents longer than ``capacity`` are cut."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rng = np.random.default_rng(task.partitionId() if task else 0)
        for batch in chunks(batches):
            ids, offsets = with_end(*tokenizer(tokenizer_path).encode(batch.column(1)), end_id)
            data = memoryview(ids.astype("<u4").tobytes())
            rows: list[tuple] = []
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                begin, end = int(offsets[k]), int(offsets[k + 1])
                for piece, at in enumerate(range(begin, end, capacity)):
                    to = min(at + capacity, end)
                    rows.append((doc_id, piece, at - begin, to - at, zlib.crc32(data[4 * at : 4 * to])))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            columns.append(rng.integers(1 << 62, size=len(rows)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in DEALT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, DEALT)


class Bins:
    """Open bins by the room that they have left; the tightest that holds a piece is one bit scan away."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, bin_: int, room: int) -> None:
        self.by_room[room].append(bin_)
        self.mask |= 1 << room

    def best(self, size: int) -> tuple[int, int] | None:
        left = self.mask >> size
        if not left:
            return None
        room = size + (left & -left).bit_length() - 1
        bin_ = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        return bin_, room


def best_fit(lengths: np.ndarray, order: np.ndarray, assigned: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the pieces of ``order`` (assigned -1) into the tightest bins of a packing, or new ones."""
    n_bins = int(assigned.max(initial=-1)) + 1
    fill = np.bincount(assigned[assigned >= 0], weights=lengths[assigned >= 0], minlength=n_bins).astype(np.int64)
    bins = Bins(capacity)
    for bin_ in range(n_bins):
        if fill[bin_] < capacity:
            bins.put(bin_, capacity - int(fill[bin_]))
    out = assigned.copy()
    for item, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = bins.best(size)
        if found is None:
            bin_, room = n_bins, capacity
            n_bins += 1
        else:
            bin_, room = found
        out[item] = bin_
        if room > size:
            bins.put(bin_, room - size)
    return out


def fitness(lengths: np.ndarray, assigned: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: smaller is better."""
    fill = np.bincount(assigned, weights=lengths)
    return len(fill), -float(np.square(fill / capacity).sum())


def crossover(one: np.ndarray, other: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(other, weights=lengths)
    full = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    injected = full[rng.random(len(full)) < 0.5]
    inject = np.isin(other, injected)
    twice = np.zeros(int(one.max()) + 1, bool)
    twice[one[inject]] = True
    stays = ~twice[one]
    child = np.full(len(one), -1, np.int64)
    child[stays] = np.unique(one[stays], return_inverse=True)[1]
    n = int(child.max(initial=-1)) + 1
    child[inject] = n + np.unique(other[inject], return_inverse=True)[1] if inject.any() else -1
    lost = np.flatnonzero(child < 0)
    return best_fit(lengths, lost[np.argsort(-lengths[lost], kind="stable")], child, capacity)


def evolve(lengths: np.ndarray, capacity: int, seed: int, elites: list[tuple[np.ndarray, bool]]) -> tuple[np.ndarray, bool]:
    """The best packing that an island finds, and whether crossover made it, as is told of the elites too; the fittest
    of parents and children live on.  It ends early at the least possible number of bins."""
    rng = np.random.default_rng(seed)
    least = -(-int(lengths.sum()) // capacity)
    none = np.full(len(lengths), -1, np.int64)
    people: list[tuple[tuple[int, float], bool, np.ndarray]] = [(fitness(lengths, x, capacity), bred, x) for x, bred in elites]
    while len(people) < POPULATION:
        # Falling lengths, shaken the more the later, but for the first island's first packing.
        shake = rng.random(len(lengths)) * (0 if not people and seed % ISLANDS == 0 else 0.05 * capacity * max(1, len(people)))
        found = best_fit(lengths, np.argsort(-(lengths + shake), kind="stable"), none, capacity)
        people.append((fitness(lengths, found, capacity), False, found))
        if people[-1][0][0] == least:
            return found, False
    people.sort(key=lambda x: x[0])
    for _ in range(GENERATIONS):
        if people[0][0][0] == least:
            break
        pairs = zip(rng.integers(POPULATION // 2, size=POPULATION // 2).tolist(), rng.integers(POPULATION, size=POPULATION // 2).tolist(), strict=True)
        children = [crossover(people[a][2], people[b][2], lengths, capacity, rng) for a, b in pairs]
        people = sorted(people + [(fitness(lengths, x, capacity), True, x) for x in children], key=lambda x: x[0])[:POPULATION]
    return people[0][2], people[0][1]


_ORDER = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pack_groups(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces with ``grp``; adds ``bin``, ``offset`` and ``fill`` of the bin, and ``bred``: whether crossover made the
    group's packing."""

    def island(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return one_epoch(key, rows, None)

    def later(key: tuple, rows: pd.DataFrame, migrants: pd.DataFrame) -> pd.DataFrame:
        return one_epoch(key, rows, migrants)

    def one_epoch(key: tuple, rows: pd.DataFrame, migrant: pd.DataFrame | None) -> pd.DataFrame:
        lengths = rows.sort_values(_ORDER, kind="stable")["length"].to_numpy(np.int64)
        open_ = lengths < capacity
        elites = [] if migrant is None else [(np.frombuffer(x, np.int64), bool(bred)) for x, bred in zip(migrant["packing"], migrant["bred"], strict=True)]
        packing, bred = evolve(lengths[open_], capacity, int(key[0]) * ISLANDS + int(key[1]), elites) if open_.any() else (np.zeros(0, np.int64), False)
        bins, squares = fitness(lengths[open_], packing, capacity) if open_.any() else (0, 0.0)
        solved = bins == -(-int(lengths[open_].sum()) // capacity)
        return pd.DataFrame({"grp": [key[0]], "island": [key[1]], "bins": [bins], "squares": [squares], "solved": [solved], "bred": [bred], "packing": [packing.tobytes()]})

    schema = "grp bigint, island int, bins bigint, squares double, solved boolean, bred boolean, packing binary"
    everywhere = pieces.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    elites = keep(everywhere.groupBy("grp", "island").applyInPandas(island, schema), "elites")
    for _ in range(EPOCHS - 1):
        solved = elites.groupBy("grp").agg(F.bool_or("solved").alias("done"))
        open_ = solved.where("not done").select("grp")
        if open_.isEmpty():
            break
        mine = elites.join(open_, "grp")
        moved = mine.union(mine.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int")))
        again = everywhere.join(open_, "grp").groupBy("grp", "island").cogroup(moved.groupBy("grp", "island")).applyInPandas(later, schema)
        following = keep(again.union(elites.join(open_, "grp", "left_anti")), "elites")
        drop(elites)
        elites = following
    best = elites.groupBy("grp").agg(F.min_by(F.struct("packing", "bred"), F.struct("bins", "squares", "island")).alias("best")).select("grp", "best.*")

    def place(key: tuple, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(_ORDER, kind="stable")
        lengths = rows["length"].to_numpy(np.int64)
        bins = np.empty(len(rows), np.int64)
        open_ = lengths < capacity
        bins[open_] = np.frombuffer(found["packing"].iloc[0], np.int64)
        bins[~open_] = int(bins[open_].max(initial=-1)) + 1 + np.arange(int((~open_).sum()))
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        before = ends - lengths[order]
        first = np.concatenate([[True], np.diff(bins[order]) > 0])
        offset = np.empty(len(rows), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        fill = np.bincount(bins, weights=lengths).astype(np.int64)[bins]
        if bins.max(initial=0) >= MOST_BINS:
            raise ValueError(f"a group has more than {MOST_BINS} bins")
        return rows.assign(bin=bins, offset=offset, fill=fill, bred=bool(found["bred"].iloc[0]))[[*_ORDER, "deal", "grp", "bin", "offset", "fill", "bred"]]

    schema = DEALT + ", grp bigint, bin bigint, offset bigint, fill bigint, bred boolean"
    return pieces.groupBy("grp").cogroup(best.groupBy("grp")).applyInPandas(place, schema)


def _grouped(pieces: DataFrame, n: int, salt: int) -> DataFrame:
    groups = max(1, -(-n // GROUP))
    return pieces.withColumn("grp", F.pmod(F.xxhash64("deal", F.lit(salt)), F.lit(groups)))


def pack(docs: DataFrame, capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id, text) with its sequence_id and the offset there; ``bred`` tells whether
    crossover made the packing of its group.

    Null and empty texts are the end id alone.  Repeated rows are packed each, and rows with a null doc_id like others;
    further columns are left out, whatever their names.  An empty table gives no rows.
    """
    pieces = keep(cut_pieces(docs, capacity, tokenizer_path or default_path(), end_id), "pieces")
    first = keep(_pack_groups(_grouped(pieces, pieces.count(), 1), capacity), "packed")
    drop(pieces)
    loose = F.col("fill") < int(LOOSE * capacity)
    again = first.where(loose).drop("grp", "bin", "offset", "fill", "bred")
    second = _pack_groups(_grouped(again, again.count(), 2), capacity)
    columns = [*_ORDER[:-1], "ids_crc32"]
    done = first.where(~loose).select(*columns, sequence_id(0).alias("sequence_id"), "offset", "bred")
    return done.union(second.select(*columns, sequence_id(1).alias("sequence_id"), "offset", "bred"))


def sequence_id(turn: int) -> Column:
    """A number for each group, bin and pass: the lowest bit is the pass, then MOST_BINS bins, then the groups."""
    return (F.col("grp") * MOST_BINS + F.col("bin")) * 2 + turn


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all ``documents``."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
