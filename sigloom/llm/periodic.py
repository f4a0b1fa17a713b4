"""Periodic run detection: which stretches of a text repeat a passage over and over, and the text without the repeats.

The words of a text are numbered as they first occur and their numbers laid out as bit planes, one big integer for each
bit.  A lag q is tested for all places at once: every plane is XORed with itself moved by q places and the results are
ORed, so a zero bit says that the words q apart agree.  AND with itself moved by 1, 2, 4, ... places leaves the zero
stretches that are long enough.

Lags below 2 * LEAST_BLOCK are all tested.  Above, for lags in [2b, 4b), a stretch of q agreeing places holds one of the
blocks of b words that begin at multiples of b, and that block occurs again q words on: only such lags are tested, and
none where the block, its copy and what lies between are inside a run of a period of at most b, as a stretch there has
that smaller period.  Blocks are found by fingerprints, which can only add lags to test, never lose one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.textbatch import chunks, mix

#: A run has at least this many words, and at least this many times its period.
LEAST_WORDS, LEAST_TIMES = 12, 2
#: Words of the smallest blocks that are sought; a power of two.
LEAST_BLOCK = 8


def number_words(words: list[bytes]) -> np.ndarray:
    """Each word's number, in the order of first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the numbers; bit i belongs to word i."""
    most = int(ids.max(initial=0)).bit_length()
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(most)]


def agreeing(planes: list[int], n: int, lag: int) -> int:
    """Bit i is set where the words i and i + lag agree."""
    differs = 0
    for plane in planes:
        differs |= plane ^ plane >> lag
    return ~differs & (1 << n - lag) - 1


def _places(bits: int) -> list[int]:
    """The set bits, in rising order."""
    if bits.bit_length() <= 64:
        out = []
        while bits:
            out.append((bits & -bits).bit_length() - 1)
            bits &= bits - 1
        return out
    data = np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(data, bitorder="little")).tolist()


def long_stretches(same: int, least: int) -> list[tuple[int, int]]:
    """First place and length of the stretches of set bits that hold ``least`` of them."""
    have = 1
    while same and have < least:
        step = min(have, least - have)
        same &= same >> step
        have += step
    if not same:
        return []
    firsts, lasts = _places(same & ~(same << 1)), _places(same & ~(same >> 1))
    return [(a, b - a + least) for a, b in zip(firsts, lasts, strict=True)]


def _prime_factors(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def _primitive(ids: np.ndarray, at: int, q: int) -> bool:
    """Whether the q words from a place on aren't a shorter passage repeated: then q is the smallest period there."""
    return not any(np.array_equal(ids[at : at + q - q // p], ids[at + q // p : at + q]) for p in _prime_factors(q))


def _runs_at(ids: np.ndarray, planes: list[int], lag: int) -> list[tuple[int, int, int]]:
    """Runs of a period: start, length, period."""
    n = len(ids)
    least = max(LEAST_WORDS - lag, (LEAST_TIMES - 1) * lag)
    if lag + least > n:
        return []
    found = long_stretches(agreeing(planes, n, lag), least)
    return [(start, length + lag, lag) for start, length in found if _primitive(ids, start, lag)]


def _doubled(prints: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of twice as many words from those of ``size`` words at each place."""
    return mix(prints[:-size] * np.uint64(0x9E3779B97F4A7C15) + prints[size:])


def _lags_of_blocks(number: np.ndarray, times: np.ndarray, block: int, runs: list[tuple[int, int, int]]) -> list[int]:
    """Lags in [2 * block, 4 * block) at which a block occurs again outside the runs of periods up to its size.

    ``number`` tells the blocks at all places apart, and ``times`` how often each of them occurs."""
    starts = np.arange(0, len(number), block)
    starts = starts[times[number[starts]] > 1]
    if not len(starts):
        return []
    ends = np.zeros(len(number), np.int64)
    for start, length, period in runs:
        if period <= block and start < len(ends):
            ends[start] = max(ends[start], start + length)
    inside = np.maximum.accumulate(ends)[starts]
    nearest = np.maximum(2 * block, inside - starts - block + 1)
    wide = np.int64(len(number) + 4 * block)
    order = np.argsort(number, kind="stable")
    keys = number[order] * wide + order
    base = number[starts] * wide + starts
    first, last = np.searchsorted(keys, base + nearest), np.searchsorted(keys, base + 4 * block)
    # A block's copies lie in its own group of equal prints: keys of other groups are further away than any lag.
    lags: set[int] = set()
    for start, a, b in zip(starts.tolist(), first.tolist(), last.tolist(), strict=True):
        if a < b:
            lags.update((order[a:b] - start).tolist())
    return sorted(lags)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length and period of every run of the numbered words, by start and then period."""
    n = len(ids)
    if n < LEAST_WORDS:
        return []
    planes = bit_planes(ids)
    runs: list[tuple[int, int, int]] = []
    for lag in range(1, min(2 * LEAST_BLOCK, n // LEAST_TIMES + 1)):
        runs += _runs_at(ids, planes, lag)
    if n < LEAST_TIMES * 2 * LEAST_BLOCK:
        return sorted(runs, key=lambda r: (r[0], r[2]))
    prints, block = mix(ids.astype(np.uint64) + np.uint64(1)), 1
    while block < LEAST_BLOCK:
        prints, block = _doubled(prints, block), 2 * block
    while 2 * block <= n // LEAST_TIMES:
        _, number, times = np.unique(prints, return_inverse=True, return_counts=True)
        if len(times) == len(prints):
            break  # no block of this size occurs twice, so no larger one does
        for lag in _lags_of_blocks(number, times, block, runs):
            runs += _runs_at(ids, planes, lag)
        prints, block = _doubled(prints, block), 2 * block
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for the words that any run holds after its first period."""
    step = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return np.cumsum(step[:-1]) == 0


def periodic_runs(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): n_words, runs (start, length, period in words, by start and then period)
    and collapsed, the text's words without repeats, joined by one space.

    Words are what blanks and \\x09-\\x0D separate.  Null, empty and blank texts have no words, no runs and an empty
    collapsed text.  Repeated rows are searched each; rows with a null doc_id like others; further columns are left
    out, whatever their names; an empty table gives no rows.  A text is one task's work, of about n log n steps and a
    pass over the planes for each lag at which a block of words occurs again.
    """
    schema = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            counts, found, texts = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                runs = find_runs(number_words(words))
                if runs:
                    keep = kept_words(len(words), runs).tolist()
                    words = [w for w, k in zip(words, keep, strict=True) if k]
                    counts.append(len(keep))
                else:
                    counts.append(len(words))
                found.append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                texts.append(b" ".join(words))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _repeated(docs: DataFrame) -> DataFrame:
    """The query's input: a tenth of the documents, by their ids, repeat a passage from a word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.col("text"), r"[\x20\x09-\x0D]+", -1), "")
    n, g = F.size("w"), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", place(i))), " ")
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    split = docs.select("doc_id", "text", F.when(chosen, words).alias("w"))
    return split.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def _digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def report(docs: DataFrame) -> DataFrame:
    """The number of runs, the longest one and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length = -F.col("top.shorter")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.floor(1000 * length / F.col("top.period")).alias("exponent_milli"), _digest(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n")))).alias("runs_sha256"),
        _digest(F.col("collapsed")).alias("collapsed_sha256"), "n_words",
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, a tenth of which are made to repeat a passage."""
    return report(_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet")))
