"""Byte-level helpers shared by the text operators that run numpy inside tasks.

A column of texts is handled as one flat byte array plus document offsets, so that lower-casing, word finding and
word hashing are a few vectorised passes over the bytes and no Python object is made per word.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once by one task.  Longer single texts are handled whole.
CHUNK_BYTES = 2_000_000
#: The same for work that makes many arrays of a chunk's bytes.
SMALL = 500_000

#: Words longer than this are fingerprinted by a digest of their bytes.
LONG_WORD = 128


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def space_table() -> np.ndarray:
    """True for the bytes that end a word: blank and \\x09 to \\x0D."""
    table = np.zeros(256, dtype=bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    return table


LOWER, SPACE = lower_table(), space_table()


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about ``size`` bytes of text and one row at least."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(batch.schema.get_field_index(text)))
        total = np.cumsum(pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and the offsets of each; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and the number of the first word of each document (with a last total)."""
    inside = ~SPACE[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))


def _piece(eights: np.ndarray, first: np.ndarray, last: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes of each word from its byte ``at`` on."""
    return eights[np.minimum(first + at, len(eights) - 1)] & _LOW_BYTES[np.clip(last - first - at, 0, 8)]


def fresh_seed() -> int:
    """A seed for fingerprints that nobody who writes texts can know."""
    return int.from_bytes(os.urandom(8), "little")


def word_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of the words ``data[first:last]``.

    A word is taken in eight bytes at a time and mixed after each, from a state that its length and ``seed`` set, so
    words of one length that differ in one stretch of eight bytes only never share a fingerprint, and others do with a
    probability of 2^-64.  Long words go by a keyed digest."""
    length = last - first
    seeded = mix(np.array([seed & (1 << 64) - 1], np.uint64))[0]
    out = mix(length.astype(np.uint64) ^ seeded)
    eights = _eights(data)
    some, at = np.flatnonzero(length <= LONG_WORD), 0
    while len(some):
        out[some] = mix(out[some] ^ _piece(eights, first[some], last[some], at))
        at += 8
        some = some[length[some] > at]
    key = int(seeded).to_bytes(8, "little")
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[first[k] : last[k]].tobytes(), digest_size=8, key=key).digest(), "little")
    return out


def equal_words(data: np.ndarray, first: np.ndarray, last: np.ndarray, other: np.ndarray, other_first: np.ndarray, other_last: np.ndarray) -> np.ndarray:
    """Whether the words of two flat arrays are the same, byte by byte, pair by pair."""
    length = last - first
    same = length == other_last - other_first
    one, two = _eights(data), _eights(other)
    some, at = np.flatnonzero(same), 0
    while len(some):
        equal = _piece(one, first[some], last[some], at) == _piece(two, other_first[some], other_last[some], at)
        same[some[~equal]] = False
        at += 8
        some = some[equal & (length[some] > at)]
    return same


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; other bytes stay."""
    return LOWER[data]
