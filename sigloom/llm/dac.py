"""Token-id files of directly addressable codes.

A block of ids is cut into levels of chunks: level 0 holds the lowest bits of every id, level k the next bits of those
ids that need them.  A bitmap beside each level tells which of its entries go on; a rank directory holds the number of
set bits before every 512th bit.  The id at any place is read by following its place through the levels, one rank at a
time, without decoding its neighbours.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of each level.  Ids of up to 32 bits.
LEVELS = (8, 8, 16)
_RANK_STEP = 512
_MAGIC = b"DAC1"


def encode(ids: np.ndarray) -> bytes:
    """The block of these ids."""
    rest = np.asarray(ids, dtype=np.uint32).astype(np.uint64)
    parts = [_MAGIC, struct.pack("<q", len(rest))]
    for level, bits in enumerate(LEVELS):
        low = rest & np.uint64((1 << bits) - 1)
        more = rest >> np.uint64(bits)
        parts.append(low.astype("<u1" if bits == 8 else "<u2").tobytes())
        if level == len(LEVELS) - 1:
            break
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little").tobytes()
        ones = np.concatenate([[0], np.cumsum(goes_on, dtype=np.int64)])
        ranks = ones[: len(rest) : _RANK_STEP].astype("<u4")
        parts += [bitmap, ranks.tobytes()]
        rest = more[goes_on]
    return b"".join(parts)


class Block:
    """Reads a block.  Nothing is decoded until asked for."""

    def __init__(self, data: bytes):
        if data[:4] != _MAGIC:
            raise ValueError("not a block of directly addressable codes")
        self.n = n = struct.unpack_from("<q", data, 4)[0]
        at, self.levels = 12, []
        for level, bits in enumerate(LEVELS):
            width = bits // 8
            values = np.frombuffer(data, "<u1" if width == 1 else "<u2", n, at)
            at += n * width
            if level == len(LEVELS) - 1:
                self.levels.append((values, None, None))
                break
            bitmap = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            ranks = np.frombuffer(data, "<u4", -(-n // _RANK_STEP), at)
            at += len(ranks) * 4
            self.levels.append((values, bitmap, ranks))
            n = int(np.unpackbits(bitmap[(max(n, 1) - 1) // _RANK_STEP * (_RANK_STEP // 8) :]).sum()) + int(ranks[-1]) if n else 0

    def get(self, place: int) -> int:
        """The id at a place: at most one rank for each level."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = shift = 0
        for (values, bitmap, ranks), bits in zip(self.levels, LEVELS, strict=True):
            value |= int(values[place]) << shift
            if bitmap is None or not bitmap[place >> 3] >> (place & 7) & 1:
                break
            shift += bits
            from_byte = place // _RANK_STEP * (_RANK_STEP // 8)
            within = np.unpackbits(bitmap[from_byte : (place >> 3) + 1], bitorder="little")[: place % _RANK_STEP]
            place = int(ranks[place // _RANK_STEP]) + int(within.sum())
        return value

    def decode(self) -> np.ndarray:
        """All ids."""
        out = np.zeros(self.n, np.uint32)
        where, shift = np.arange(self.n), 0
        for (values, bitmap, _), bits in zip(self.levels, LEVELS, strict=True):
            out[where] |= values.astype(np.uint32) << np.uint32(shift)
            if bitmap is not None:
                where = where[np.unpackbits(bitmap, count=len(where), bitorder="little").astype(bool)]
                shift += bits
        return out
