"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A sketch has T places.  In round i every shingle is hashed to a place (round T + j: all to place j) and a value; a place
keeps the smallest (round, value) it has met, and the rounds end when every place is filled, as they are after 2T rounds
whatever the set.  Two sets agree at a place with the probability of their Jaccard similarity, and sketches of all
places concentrate as well as independent ones.  BANDS bands of ROWS places each find a pair of similarity 0.8 but with
probability (1 - 0.8^ROWS)^BANDS, about 2.5e-7; links are then confirmed on the full sets.

Groups of copies never become pairs: equal sets are one class; each bucket of a band is first a star around the class
that shares most with others; only buckets that links leave in several components are compared further, block by block
inside tasks, and only pairs that join components leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.components import components
from sigloom.llm.joins import hot_from, join_hot
from sigloom.llm.store import keep
from sigloom.llm.textbatch import SMALL, chunks, flat, fresh_seed, lower, mix, word_bounds, word_hashes

ROWS, BANDS = 6, 50
T = ROWS * BANDS
#: Classes of a bucket that a task compares with as many others at once.
BLOCK = 256
#: A pair whose sketches agree in less than the threshold less so many standard deviations is none.
SIGMAS = 6.5


def shingle_sets(column: pa.Array, words: int, seed: int = 0) -> list[np.ndarray]:
    """The sorted 64-bit fingerprints of each text's distinct shingles; of the whole sequence if it has fewer words."""
    data, offsets = flat(column)
    data = lower(data)
    first, last, bounds = word_bounds(data, offsets)
    hashes = word_hashes(data, first, last, seed)
    rolled = np.full(max(0, len(hashes) - words + 1), words, np.uint64)
    for k in range(words if len(rolled) else 0):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(rolled)])
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + 1])
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


_ROUND_BITS, _PLACE_BITS = 11, 10


def sketch(elements: np.ndarray, t: int = T) -> np.ndarray:
    """The t places of a set that isn't empty: (round, value) as one number each."""
    out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    place_shift, round_shift = np.uint64(64 - _PLACE_BITS), np.uint64(64 - _PLACE_BITS - _ROUND_BITS)
    value_bits = np.uint64(_PLACE_BITS + _ROUND_BITS)
    filled, start = 0, 0
    while filled < t and start < 2 * t:
        rounds = max(1, min(2 * t - start, -(-t * 4 // len(elements))))
        index = np.arange(start, start + rounds, dtype=np.uint64)
        hashed = mix(elements[None, :] + mix(index + np.uint64(1))[:, None])
        place = mix(hashed) % np.uint64(t)
        late = index >= t
        if late.any():
            place[late] = (index[late] - np.uint64(t))[:, None]
        packed = ((place << place_shift) | (index[:, None] << round_shift) | (hashed >> value_bits)).ravel()
        packed.sort()
        places = packed >> place_shift
        firsts = np.concatenate([[0], np.flatnonzero(places[1:] != places[:-1]) + 1])
        spot = places[firsts].astype(np.int64)
        out[spot] = np.minimum(out[spot], packed[firsts] & ((np.uint64(1) << place_shift) - np.uint64(1)))
        filled = int((out != np.iinfo(np.uint64).max).sum())
        start += rounds
    return out


def bands_of(places: np.ndarray) -> np.ndarray:
    """One number for each band of a sketch."""
    rows = places.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def sketches(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, the 128-bit digest of the set and its bands (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=SMALL):
            sets = shingle_sets(batch.column(1), words, seed)
            digests = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            bands = [bands_of(sketch(s)) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), _lists(bands)],
                names=["doc_id", "n_shingles", "d1", "d2", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>")


def _sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=SMALL):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(shingle_sets(batch.column(1), words, seed))], names=["rep", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "rep bigint, shingles array<bigint>")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  An a has few pairs; a b with very many is dealt to as many
    tasks as its pairs take, each with one copy of its set."""
    least = hot_from(total)
    parts = F.ceil(F.col("n") / least).cast("int")
    hot = F.broadcast(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("b", parts.alias("parts")))
    dealt = pairs.join(hot, "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")).join(hot, "b", "left")
    two = two.select("b", "sb", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    both = dealt.join(one, "a").join(two, ["b", "part"])
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def _reaches(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(other) - common)


def _block_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join components within buckets.  rest: band, no, rep, comp.

    Buckets are cut into blocks; a task compares two blocks in memory, one of them outside the largest component: first
    the sketches, then, for pairs that these allow and that meet in no earlier band, the full sets.  Sketches are
    compared by 16 bits of each place, which only adds agreements, and allow pairs down to SIGMAS standard deviations
    below the threshold.  A pair leaves the task if it joins what the task hasn't joined yet, so fewer pairs leave than
    classes come in."""
    least = int(T * (percent / 100 - SIGMAS * (percent / 100 * (1 - percent / 100) / T) ** 0.5))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).values.to_numpy().view(np.uint64)
            offsets = batch.column(1).offsets.to_numpy()
            every = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            drawn = [sketch(x) for x in every]
            places = [mix(x).astype(np.uint16).tobytes() for x in drawn]
            bands = [bands_of(x).tobytes() for x in drawn]
            columns = [batch.column(0), *(pa.array(x, pa.binary()) for x in (places, bands, [x.tobytes() for x in every]))]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "places", "bands", "full"])

    wanted = rest.select("rep").distinct()
    folded = keep(sets.join(wanted, "rep").select("rep", "shingles").mapInArrow(fold, "rep bigint, places binary, bands binary, full binary"), "places")
    # The largest component of a bucket needs no comparison with itself: its blocks meet those of the others only.
    parts = rest.groupBy("band", "comp").agg(F.count("*").alias("n"))
    top = parts.groupBy("band").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("n_top"), F.sum("n").alias("n_all"))
    rows = join_hot(rest, keep(top, "tops"), ["band"], "n_all", rest.count()).withColumn("minor", F.col("comp") != F.col("top"))
    m, most = (F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int") for n in (F.col("n_all") - F.col("n_top"), F.col("n_top")))
    dealt = F.xxhash64("rep")
    rows = rows.withColumn("block", F.when(F.col("minor"), F.pmod(dealt, m)).otherwise(m + F.pmod(dealt, most)).cast("int"))
    # Any other pair of blocks meets once.
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), m + most - 1).otherwise(m - 1))))
    rows = rows.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "no", "block", "rep", "comp")
    rows = rows.join(folded, "rep")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable")
        places = np.frombuffer(b"".join(rows["places"]), np.uint16).reshape(len(rows), T)
        bands = np.frombuffer(b"".join(rows["bands"]), np.uint64).reshape(len(rows), BANDS)
        full = [np.frombuffer(x, np.uint64) for x in rows["full"]]
        n = np.array([len(x) for x in full])
        rep, block, comp = (rows[c].to_numpy() for c in ("rep", "block", "comp"))
        comp = comp.copy()
        i, j, no = rows["i"].iloc[0], rows["j"].iloc[0], rows["no"].iloc[0]
        found = []
        for row in range(len(rows) - 1):
            later = slice(row + 1, None)
            may = (comp[later] != comp[row]) & (100 * np.minimum(n[later], n[row]) >= percent * np.maximum(n[later], n[row]))
            against = row + 1 + np.flatnonzero(may & ((i == j) | (block[later] != block[row])))
            if not len(against):
                continue
            alike = (places[against] == places[row]).sum(axis=1) >= least
            first = (bands[against] == bands[row]).argmax(axis=1)
            for other in against[alike & (first == no)].tolist():
                if comp[other] != comp[row] and _reaches(full[row], full[other], percent):
                    found.append((rep[row], rep[other]))
                    comp[comp == comp[other]] = comp[row]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs[:, 1], "b": pairs[:, 0]})

    return rows.groupBy("band", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept, for every row of ``docs``.

    A link: 100 * intersection >= percent * union of the sets of distinct shingles.  Texts that are null or have no
    words link with nothing.  Rows that share a doc_id are one node that each of their texts links; rows with a null
    doc_id take no part and have themselves as component (null).  An empty table gives no rows.
    """
    seed = fresh_seed()
    found = keep(sketches(docs, words, seed), "sketches")
    taking = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    full = found.where(taking)
    reps = full.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "bands")).alias("r"), F.count("*").alias("copies"))
    reps = keep(reps.select("d1", "d2", "copies", F.col("r.doc_id").alias("rep"), "r.bands"), "classes")
    bands = reps.select("rep", F.posexplode("bands").alias("no", "band"))
    sizes = keep(bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    n_full, n_shared = (r or 0 for r in (reps.agg(F.sum("copies")).first()[0], sizes.agg(F.sum("size")).first()[0]))
    buckets = keep(join_hot(bands, sizes, ["band"], "size", n_shared), "buckets")
    mass = buckets.groupBy("rep").agg(F.sum("size").alias("mass"))
    weighed = buckets.join(mass, "rep")
    centres = keep(weighed.groupBy("band").agg(F.max_by("rep", F.struct("mass", -F.col("rep"))).alias("b"), F.count("*").alias("size")), "centres")
    stars = keep(join_hot(buckets.select("band", "rep"), centres, ["band"], "size", n_shared).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct(), "stars")
    sets = keep(_sets(docs.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), words, seed), "sets")
    links = keep(_linked(stars, sets, percent, n_shared), "links")
    parts = keep(components(links), "parts")
    # Buckets of three classes or more that stay in several components: their other pairs.
    labelled = buckets.where("size > 2").join(parts, buckets["rep"] == parts["node"], "left").select("band", "no", "rep", F.coalesce("component", "rep").alias("comp"))
    labelled = keep(labelled, "labelled")
    open_ = labelled.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size")
    rest = keep(join_hot(labelled, keep(open_, "open"), ["band"], "size", n_shared).drop("size"), "rest")
    if not rest.isEmpty():
        links = keep(links.union(_block_links(rest, sets, percent)), "links")
        parts = keep(components(links), "parts")
    named = keep(reps.join(parts, reps["rep"] == parts["node"], "left").select("d1", "d2", "copies", F.coalesce("component", "rep").alias("component")), "named")
    columns = ["doc_id", "n_shingles", "d1", "d2"]
    joined = join_hot(full.select(*columns), named, ["d1", "d2"], "copies", n_full).select("doc_id", "n_shingles", "component")
    rows = joined.union(found.where(~taking).select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` under two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2)
