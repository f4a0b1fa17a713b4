"""LM scoring: an interpolated modified Kneser-Ney model of order 2 or 3, counted in Spark, kept as sorted arrays.

Tasks count what they read and send sorted arrays to the shard of each word or n-gram; a shard's task adds them up and
writes one file of sorted keys and counts to the shared folder (under a new name, then renamed, so that repeated tasks
do no harm).  Scoring workers memory-map those files and look up whole batches of n-grams at once.  Nothing that grows
with the corpus passes the driver: it sees the sizes of the shards of words, 65 536 at most, and twelve counts of counts.

A trigram's key is the place of its first two words' bigram in that bigram's shard, times the words, plus its last word:
exact, as what 64 bits don't hold is refused, and in the same shard.  As usual, the bigrams below trigrams count the different words before
them, and those at a text's start, which have none, their occurrences; a text's first word has the bigram model alone.

The shared folder must be mounted where executors run, as files can't be mapped otherwise.
"""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.quality import fold_of
from sigloom.llm.store import drop, keep, new_folder
from sigloom.llm.textbatch import chunks, flat, fresh_seed, lower, mix, word_bounds, word_hashes

#: Tokens that a task counts before it sends sums; tokens for each shard of bigrams; shards at least.
FLUSH, SHARD_TOKENS, SHARDS = 4_000_000, 4_000_000, 64
#: Bytes of sums that a task packs before it sends them.
HELD = 8_000_000
#: Order of the query's model.
ORDER = 3
#: Upper bits of a word's hash that name its shard, at least and at most, and bytes of text for each shard of words.
WORD_BITS, MOST_BITS, SHARD_BYTES = 8, 16, 1 << 28
#: Words in a stretch of the statistics, and in one of a model of more shards than MANY.
STRETCH, SHORT_STRETCH, MANY = 1 << 16, 1 << 12, 4096
#: Files that a worker maps at once.
MAPS = 16_384
#: Counts of trigrams from here up are kept apart from the bytes that hold the others.
BYTE = 255
END = np.uint64(0xE0D)

PARTS = "shard bigint, n bigint, a binary, b binary"


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte: the upper bytes are zeros, which the shuffle's codec packs."""
    steps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack_counts(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return keys[first], np.add.reduceat(counts, np.flatnonzero(first)) if len(keys) else counts


def _local(folder: str) -> str:
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model's files must be in a mounted folder, not {folder}")
    return url.path


def _write(folder: str, name: str, *arrays: np.ndarray) -> None:
    _write_more(folder, name, dict(enumerate(arrays)))


def _write_more(folder: str, name: str, arrays: dict[int, np.ndarray]) -> None:
    os.makedirs(folder, exist_ok=True)
    for k, array in arrays.items():
        temporary = f"{folder}/.{uuid.uuid4().hex}"
        array.tofile(temporary)
        os.replace(temporary, f"{folder}/{name}-{k}")


def _map(folder: str, name: str, k: int, kind: type) -> np.ndarray:
    path = f"{folder}/{name}-{k}"
    return np.memmap(path, kind, "r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all of them fit: half the disk."""
    return counts.astype(np.uint64 if len(counts) and counts.max() >> np.uint64(32) else np.uint32)


def tokens_of(column: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and its end, in a row, and the first of each text."""
    data, offsets = flat(column)
    data = lower(data)
    first, last, bounds = word_bounds(data, offsets)
    hashes = word_hashes(data, first, last, seed)
    hashes[hashes == END] += np.uint64(1)
    n = len(column)
    starts = bounds + np.arange(n + 1)
    out = np.empty(len(hashes) + n, np.uint64)
    keep = np.ones(len(out), bool)
    keep[starts[1:] - 1] = False
    out[keep], out[~keep] = hashes, END
    return out, starts


@dataclass
class Model:
    """Where the arrays are, and the few numbers that go with them."""

    folder: str
    word_bits: int = WORD_BITS
    word_sizes: list[int] = field(default_factory=list)
    tokens: int = 0
    shards: int = SHARDS
    discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    lower_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    continuations: int = 0
    lower_rest: float = 1.0
    order: int = 2
    middle_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    seed: int = 0

    def __post_init__(self) -> None:
        self._maps: dict = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_maps": {}}

    @property
    def words(self) -> int:
        return sum(self.word_sizes)

    def _mapped(self, name: str, k: int, kind: type) -> np.ndarray:
        found = self._maps.pop((name, k), None)
        if found is None:
            found = _map(self.folder, name, k, kind)
            while len(self._maps) >= MAPS:
                self._maps.pop(next(iter(self._maps)))
        self._maps[name, k] = found  # the one used last stands last
        return found

    def _counts(self, name: str, k: int, n: int) -> np.ndarray:
        """A file of n counts, of 32 or 64 bits each as its size tells."""
        found = self._mapped(name, k, np.uint32)
        return found if len(found) <= n else found.view(np.uint64)

    @property
    def stretch(self) -> int:
        return STRETCH if self.shards <= MANY else SHORT_STRETCH

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word in the order of all hashes (-1: unknown), and its count."""
        unique, back = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(unique), -1, np.int64), np.zeros(len(unique), np.int64)
        edges = np.searchsorted(unique, np.arange(1 << self.word_bits, dtype=np.uint64) << np.uint64(64 - self.word_bits))
        edges = np.append(edges, len(unique))
        bases = np.concatenate([[0], np.cumsum(np.array(self.word_sizes, np.int64))])
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            a, b, base = edges[shard], edges[shard + 1], bases[shard]
            known = self._mapped(f"word{shard}", 0, np.uint64)
            if len(known):
                spot = np.minimum(np.searchsorted(known, unique[a:b]), len(known) - 1)
                hit = known[spot] == unique[a:b]
                ids[a:b] = np.where(hit, spot + base, -1)
                counts[a:b] = np.where(hit, self._mapped(f"word{shard}", 1, np.uint64)[spot].astype(np.int64), 0)
        return ids[back], counts[back]

    def bigrams(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token (the start of a text is one more word) and the bigram's key."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts[:-1]] = self.words
        return before, (before.astype(np.uint64) * np.uint64(self.words + 1)) + ids.astype(np.uint64)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of each bigram and its place there (-1: unknown)."""
        keys, back = np.unique(keys, return_inverse=True)
        shard = (mix(keys) % np.uint64(self.shards)).astype(np.int64)
        place = np.full(len(keys), -1, np.int64)
        for s, some in _by_shard(shard):
            known = self._mapped(f"pair{s}", 0, np.uint64)
            if len(known):
                spot = np.minimum(np.searchsorted(known, keys[some]), len(known) - 1)
                place[some] = np.where(known[spot] == keys[some], spot, -1)
        return shard[back], place[back]

    def of_pairs(self, shard: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, count below trigrams and share left to the bigrams after it, of the bigram at each place.

        Only bigrams met more than once are in a file; for others these are 1, 1 and the first discount."""
        counted, below, share = (place >= 0).astype(np.int64), (place >= 0).astype(np.int64), np.full(len(place), self.discounts[0])
        for s, some in _by_shard(np.where(place >= 0, shard, -1)):
            met = self._mapped(f"more{s}", 0, np.uint32)
            if len(met):
                spot = np.minimum(np.searchsorted(met, place[some].astype(np.uint32)), len(met) - 1)
                hit = met[spot] == place[some]
                some, spot = some[hit], spot[hit]
                counted[some] = self._counts(f"more{s}", 1, len(met))[spot]
                if self.order == 3 and self.middle_discounts[0]:
                    below[some] = self._counts(f"more{s}", 2, len(met))[spot]
                    share[some] = self._mapped(f"more{s}", 3, np.float64)[spot]
        return counted, below, share

    def trigrams(self, shard: np.ndarray, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """How often each word follows the bigram at the place."""
        out = np.zeros(len(ids), np.int64)
        for s, some in _by_shard(np.where((place >= 0) & (ids >= 0), shard, -1)):
            known = self._mapped(f"tri{s}", 0, np.uint64)
            if len(known):
                keys = self.trigram_keys(place[some], ids[some])
                order = np.argsort(keys)
                keys, some = keys[order], some[order]
                spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[spot] == keys
                out[some[hit]] = self.trigram_counts(s, spot[hit])
        return out

    def trigram_counts(self, shard: int, spot: np.ndarray) -> np.ndarray:
        counts = self._mapped(f"tri{shard}", 1, np.uint8)[spot].astype(np.int64)
        many = np.flatnonzero(counts == BYTE)
        if len(many):
            large = np.searchsorted(self._mapped(f"tri{shard}", 2, np.int64), spot[many])
            counts[many] = self._mapped(f"tri{shard}", 3, np.int64)[large]
        return counts

    def trigram_keys(self, place: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The trigrams of a shard: the place of the first bigram there, and the last word.  ``fits`` sees to 64 bits."""
        return place.astype(np.uint64) * np.uint64(self.words + 1) + ids.astype(np.uint64)

    def statistics(self, ids: np.ndarray) -> np.ndarray:
        """For each word: total as context, its followers met once, twice, more often; and its continuation count."""
        unique, back = np.unique(ids, return_inverse=True)
        out = np.zeros((len(unique), 5))
        for stretch in np.unique(unique[unique >= 0] // self.stretch).tolist():
            mine = (unique >= 0) & (unique // self.stretch == stretch)
            table = self._counts(f"stat{stretch}", 0, 5 * self.stretch)
            if len(table):
                out[mine] = table.reshape(-1, 5)[unique[mine] % self.stretch]
        return out[back]

    def log10(self, hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log10 probability of each token, and its count in the training tokens."""
        ids, counts = self.ids(hashes)
        before, keys = self.bigrams(ids, starts)
        both = (ids >= 0) & (before >= 0)
        shard, place = np.zeros(len(ids), np.int64), np.full(len(ids), -1, np.int64)
        shard[both], place[both] = self.places(keys[both])
        counted, below, share = self.of_pairs(shard, place)
        pair = below if self.order == 3 else counted
        discounts = self.middle_discounts if self.order == 3 else self.discounts
        own, context = self.statistics(ids), self.statistics(before)
        follow = own[:, 4]
        low = np.full(len(ids), self.lower_rest / (self.words + 1))
        if self.continuations:
            low += np.maximum(follow - _discount(self.lower_discounts, follow), 0) / self.continuations
        total = np.maximum(context[:, 0], 1)
        rest = context[:, 1:4] @ np.array(discounts) / total
        high = np.maximum(pair - _discount(discounts, pair), 0) / total + rest * low
        p = np.where(context[:, 0] > 0, high, low)
        if self.order == 3:
            at = np.ones(len(ids), bool)
            at[starts[:-1]] = False
            at = np.flatnonzero(at)
            at = at[place[at - 1] >= 0]
            three = self.trigrams(shard[at - 1], place[at - 1], ids[at])
            p[at] = np.maximum(three - _discount(self.discounts, three), 0) / counted[at - 1] + share[at - 1] * p[at]
        return np.log10(p), counts


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard from 0 up with the places of its items, in their order."""
    order = np.argsort(shard, kind="stable")
    found, first = np.unique(shard[order], return_index=True)
    for s, a, b in zip(found.tolist(), first, [*first[1:], len(order)][: len(first)], strict=True):
        if s >= 0:
            yield s, order[a:b]


def _discount(discounts: tuple[float, ...], counts: np.ndarray) -> np.ndarray:
    return np.array([0.0, *discounts])[np.minimum(counts, 3).astype(np.int64)]


def modified_discounts(n: list[int]) -> tuple[float, ...]:
    """The discounts of counts 1, 2 and above, from how many counts are 1, 2, 3 and 4; each between 0 and the count."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1:
        return (0.5, 0.5, 0.5)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def fits(count: int, words: int) -> None:
    """Raises if pairs of one of ``count`` things and one of the words, or of what stands for the start or the end of a
    text, can't be told apart in 64 bits."""
    if count * (words + 1) >= 1 << 64:
        raise OverflowError(f"{count} contexts with {words} words each need more than 64 bits: raise the number of shards")


def _parts(name_of: np.ndarray | list, *columns: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((name_of, *columns), kinds, strict=True)], names=["shard", "n", "a", "b"])


def _batched(found: Iterator[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Keys and counts of shards as rows of packed arrays, some HELD bytes of them at a time."""
    rows, size = [], 0
    for shard, keys, counts in found:
        rows.append((shard, len(keys), _pack(keys), _pack_counts(counts)))
        size += 16 * len(keys)
        if size >= HELD:
            yield _parts(*map(list, zip(*rows, strict=True)))
            rows, size = [], 0
    if rows:
        yield _parts(*map(list, zip(*rows, strict=True)))


def _split(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums by key as a row of packed arrays for each shard."""
    return _batched((s, keys[some], counts[some]) for s, some in _by_shard(shard))


def _counted(docs: DataFrame, seed: int, keys_of: Callable, sums_of: Callable) -> DataFrame:
    """Adds up keys inside each task and sends the sums to their shards.  ``keys_of`` gives some columns for the tokens
    of a few texts, and ``sums_of`` makes rows of columns that are full enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def taken() -> Iterator[np.ndarray]:
            while held:
                yield np.concatenate(held.pop(0))  # its parts go before the next column's are put together

        n = 0
        for batch in chunks(batches):
            columns = keys_of(*tokens_of(batch.column(0), seed))
            held = held or [[] for _ in columns]
            for part, column in zip(held, columns, strict=True):
                part.append(column)
            n += len(columns[0])
            if n >= FLUSH:
                yield from sums_of(*taken())
                n = 0
        if held:
            yield from sums_of(*taken())

    return docs.select("text").mapInArrow(run, PARTS)


def _sums_of(shard_of: Callable) -> Callable:
    """Sums of keys that name their shard."""

    def sums(keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(keys, return_counts=True)
        return _split(keys, counts, shard_of(keys).astype(np.int32))

    return sums


def _sums_in_shards(keys: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """Sums of keys that mean something inside their shard only."""
    found = [(s, *np.unique(keys[some], return_counts=True)) for s, some in _by_shard(shard)]
    return _parts(np.array([s for s, _, _ in found], np.int64), [len(k) for _, k, _ in found], [_pack(k) for _, k, _ in found], [_pack_counts(c) for _, _, c in found])


def _shard_by_shard(keys: np.ndarray, shard: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The same by some shards at a time, so that sums of few keys are there at once."""
    rows, n = [], 0
    for _, some in _by_shard(shard):
        rows.append(some)
        n += len(some)
        if 16 * n >= HELD:
            some = np.concatenate(rows)
            yield _sums_in_shards(keys[some], shard[some])
            rows, n = [], 0
    if rows:
        some = np.concatenate(rows)
        yield _sums_in_shards(keys[some], shard[some])


def _merged(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _sum_by_key(np.concatenate([_unpack(x) for x in rows["a"]]), np.concatenate([_unpack_counts(x) for x in rows["b"]]))


def train(docs: DataFrame, order: int = 2) -> Model:
    """Counts every whole text of ``docs`` (text) and writes the model.  Null and empty texts are an end each."""
    if order not in (2, 3):
        raise ValueError(f"the order must be 2 or 3, not {order}")
    folder = _local(new_folder(docs.sparkSession, "lm"))
    model = Model(folder, order=order, seed=fresh_seed())

    # Words go to shards by their upper bits, so the shards in a row are sorted.
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = model.word_bits = min(MOST_BITS, max(WORD_BITS, (n_bytes // SHARD_BYTES).bit_length()))
    word_parts = _counted(docs, model.seed, lambda hashes, starts: (hashes,), _sums_of(lambda keys: (keys >> np.uint64(64 - bits)).astype(np.int64)))

    def write_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        _write(folder, f"word{key[0]}", keys, counts)
        return pd.DataFrame({"shard": [key[0]], "words": [len(keys)], "tokens": [int(counts.sum())]})

    sizes = word_parts.groupBy("shard").applyInPandas(write_words, "shard bigint, words bigint, tokens bigint").collect()
    model.word_sizes = [0] * (1 << bits)
    for r in sizes:
        model.word_sizes[r.shard] = r.words
        model.tokens += r.tokens
    model.shards = max(SHARDS, -(-model.tokens // SHARD_TOKENS))
    _release(docs.sparkSession)

    fits(model.words + 1, model.words)

    def pair_keys(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray]:
        return (model.bigrams(model.ids(hashes)[0], starts)[1],)

    pairs = _counted(docs, model.seed, pair_keys, _sums_of(lambda keys: (mix(keys) % np.uint64(model.shards)).astype(np.int64)))
    size = np.uint64(model.words + 1)

    def summary(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        """Counts of counts of some bigrams, and what their words are to know of them."""
        context, word = keys // size, keys % size
        out = [("", 0, [], [int((counts == c).sum()) for c in (1, 2, 3, 4)])]
        firsts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
        columns = [np.add.reduceat(x.astype(np.uint64), firsts) if len(keys) else x.astype(np.uint64) for x in (counts, counts == 1, counts == 2, counts >= 3)]
        out += _stretches("context", context[firsts], np.stack(columns, axis=1), model.stretch)
        found, times = np.unique(word, return_counts=True)
        out += _stretches("word", found, times.astype(np.uint64)[:, None], model.stretch)
        return pd.DataFrame({"kind": [x[0] for x in out], "stretch": [x[1] for x in out], "ids": [_pack(np.array(x[2], np.uint64)) for x in out], "counts": [_pack_counts(np.ascontiguousarray(x[3]).ravel() if len(x[2]) else np.array(x[3])) for x in out]})

    summaries = "kind string, stretch bigint, ids binary, counts binary"

    def write_pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        fits(len(keys), model.words)
        more = np.flatnonzero(counts > 1)
        _write(folder, f"pair{key[0]}", keys)
        _write(folder, f"more{key[0]}", more.astype(np.uint32), _narrow(counts[more].astype(np.uint64)))
        return pd.DataFrame({"n": [1]}) if order == 3 else summary(keys, counts)

    if order == 3:
        pairs.groupBy("shard").applyInPandas(write_pairs, "n int").agg(F.sum("n")).collect()
        _release(docs.sparkSession)
        partial = keep(_trigrams(docs, model, summary, summaries), "statistics")
    else:
        partial = keep(pairs.groupBy("shard").applyInPandas(write_pairs, summaries), "statistics")

    def write_statistics(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((model.stretch, 5), np.uint64)
        for kind, ids, counts in rows[["kind", "ids", "counts"]].itertuples(index=False):
            spot = (_unpack(ids) % np.uint64(model.stretch)).astype(np.int64)
            values = _unpack_counts(counts).reshape(len(spot), -1)
            if kind == "context":
                table[spot, :4] += values
            else:
                table[spot, 4] += values[:, 0]
        _write(folder, f"stat{key[0]}", _narrow(table.ravel()))
        follow = table[:, 4]
        return pd.DataFrame({"n": [[*[int((follow == c).sum()) for c in (1, 2, 3, 4)], int((follow >= 3).sum()), int(follow.sum())]]})

    lower_counts = partial.where("kind <> ''").groupBy("stretch").applyInPandas(write_statistics, "n array<bigint>")
    low = lower_counts.select([F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(6)]).first()
    low = [int(x or 0) for x in low]
    high = np.zeros(4, np.int64)
    for r in partial.where("kind = ''").select("counts").toLocalIterator():
        high += _unpack_counts(bytes(r.counts)).astype(np.int64)
    drop(partial)
    _release(docs.sparkSession)
    if order == 3:
        model.middle_discounts = modified_discounts(high.tolist())
    else:
        model.discounts = modified_discounts(high.tolist())
    model.lower_discounts = modified_discounts(low[:4])
    model.continuations = low[5]
    if low[5]:
        model.lower_rest = float(np.dot(model.lower_discounts, [low[0], low[1], low[4]]) / low[5])
    return model


def _release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs that are over: it does so after a collection in the driver."""
    gc.collect()
    spark._jvm.System.gc()


def _trigrams(docs: DataFrame, model: Model, summary: Callable, schema: str) -> DataFrame:
    """Writes the trigrams, sets their discounts and returns the summaries of the bigrams as these count below them;
    their task writes what a bigram counts there, and the share of the words after it that is left to the bigrams."""
    spark, folder = docs.sparkSession, model.folder
    size = np.uint64(model.words + 1)

    def keys_of(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = model.ids(hashes)[0]
        shard, place = model.places(model.bigrams(ids, starts)[1])
        at = np.ones(len(ids), bool)
        at[starts[:-1]] = False
        at = np.flatnonzero(at)
        return model.trigram_keys(place[at - 1], ids[at]), shard[at - 1].astype(np.int32)

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _merged(rows)
        large = np.flatnonzero(counts >= BYTE)
        _write(folder, f"tri{key[0]}", keys, np.minimum(counts, BYTE).astype(np.uint8), large.astype(np.int64), counts[large].astype(np.int64))
        return pd.DataFrame({"n": [[int((counts == c).sum()) for c in (1, 2, 3, 4)]]})

    counted = _counted(docs, model.seed, keys_of, _shard_by_shard).groupBy("shard").applyInPandas(write, "n array<bigint>")
    found = counted.select([F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(4)]).first()
    model.discounts = modified_discounts([int(x or 0) for x in found])

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bigrams that end a shard's trigrams; and for each shard a row, as one may have no such bigram."""
        for batch in batches:
            for s in batch.column(0).to_pylist():
                yield _parts(np.array([s]), [0], [b""], [b""])
                known = model._mapped(f"tri{s}", 0, np.uint64)
                if len(known):
                    middle = np.asarray(model._mapped(f"pair{s}", 0, np.uint64))[(known // size).astype(np.int64)] % size
                    keys, counts = np.unique(middle * size + known % size, return_counts=True)
                    more = model.of_pairs(*model.places(keys))[0] > 1  # the others have one word before them
                    keys, counts = keys[more], counts[more]
                    yield from _split(keys, counts, (mix(keys) % np.uint64(model.shards)).astype(np.int64))

    def middle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = key[0]
        keys, more = np.asarray(model._mapped(f"pair{s}", 0, np.uint64)), np.asarray(model._mapped(f"more{s}", 0, np.uint32))
        ends, times = _merged(rows)
        counted = np.ones(len(keys), np.uint64)
        counted[more] = model._counts(f"more{s}", 1, len(more))
        counts = counted.copy()
        inside = more[keys[more] // size != np.uint64(model.words)]
        counts[inside] = times[np.searchsorted(ends, keys[inside])]
        known = model._mapped(f"tri{s}", 0, np.uint64)
        left = np.zeros(len(keys))
        if len(known):
            discount = _discount(model.discounts, model.trigram_counts(s, np.arange(len(known))))
            left = np.bincount((known // size).astype(np.int64), weights=discount, minlength=len(keys))
        _write_more(folder, f"more{s}", {2: _narrow(counts[more]), 3: left[more] / counted[more]})
        return summary(keys, counts)

    _release(spark)
    shards = spark.range(0, model.shards, 1, min(model.shards, 1 << 15))
    return shards.mapInArrow(below, PARTS).groupBy("shard").applyInPandas(middle, schema)


def _stretches(kind: str, ids: np.ndarray, values: np.ndarray, size: int) -> list[tuple]:
    stretch = (ids // np.uint64(size)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate([[True], stretch[1:] != stretch[:-1]])) if len(ids) else np.zeros(0, int)
    return [(kind, int(stretch[a]), ids[a:b], values[a:b]) for a, b in zip(edges, [*edges[1:], len(ids)][: len(edges)], strict=True)]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of every row of ``docs``."""
    scale = np.log10(model.tokens + 0.5 * (model.words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, starts = tokens_of(batch.column(1), model.seed)
            logs, counts = model.log10(hashes, starts)
            n = np.diff(starts)
            total = np.add.reduceat(logs, starts[:-1])
            base = np.add.reduceat(np.log10(counts + 0.5) - scale, starts[:-1])
            known = np.add.reduceat((counts > 0).astype(np.int64), starts[:-1])
            columns = [batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens, np.int64)), pa.array(base), pa.array(total), pa.array(np.power(10.0, -total / n))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def train_and_score(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learns from the rows whose crc32(doc_id as text) mod 5 isn't 1 and scores all.

    Null texts count as empty: an end alone.  Rows with a null doc_id are learnt from.  Repeated rows count each.  With
    nothing to learn from, every token has probability 1 (one unknown word).  An empty table gives no rows.
    """
    held_out = F.coalesce(fold_of("doc_id", 5) == 1, F.lit(False))
    model = train(docs.where(~held_out), order)
    found = score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), *found.columns[1:])


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all ``documents``."""
    return train_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), ORDER)
