"""Token ids of whole texts by a public tokenizer, fast enough for a corpus.

The tokenizer splits at white space before it merges, so the ids of a text are those of its words, one after another.
Each worker keeps the ids of words that it has met in sorted arrays (bounded by ``CACHE_WORDS``) and asks the library
only for new ones.  A fingerprint only tells where to look: a word has the ids of a known one if all their bytes agree.
The tests hold the ids against the library's own over whole texts.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from sigloom.llm.textbatch import equal_words, flat, lower, word_bounds, word_hashes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words that a worker remembers (about 70 bytes each) and bytes of theirs; beyond either it starts anew.
CACHE_WORDS, CACHE_BYTES = 1_500_000, 64_000_000
#: Words given to the library at once.
ASK = 4096

#: ASCII marks, but for those of contractions and special tokens.
_TAIL = np.zeros(256, bool)
_TAIL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<>|"]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of words, remembered by their 64-bit fingerprints and their bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)
        self.bytes = np.zeros(0, np.uint8)
        self.first = self.last = np.zeros(0, np.int64)

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        count, parts = self._ask([word.decode("utf-8", "replace") for word in words])
        begin = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        sizes = np.array([len(word) for word in words], np.int64)
        last = len(self.bytes) + np.cumsum(sizes)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        columns = (("begin", begin), ("count", count), ("first", last - sizes), ("last", last))
        for name, new in columns:
            setattr(self, name, np.concatenate([getattr(self, name), new])[order])
        self.ids = np.concatenate([self.ids, parts])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), np.uint8)])

    def _ask(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word, and all their ids in a row, from the library.

        Small ASCII letters need no normalising and are one piece, so they go to the merges at once.  Other words of
        letters only are one piece each and go as one text, cut again where an id ends a piece.  All else goes alone.
        """
        found: list[list[int]] = [[]] * len(words)
        letters, others = [], []
        merge = self.tokenizer.model.tokenize
        for k, word in enumerate(words):
            if word.isascii() and word.isalpha() and word.islower():
                found[k] = [token.id for token in merge(word)]
            else:
                (letters if word.isalpha() and word.lower().isalpha() else others).append(k)
        for at in range(0, len(letters), ASK):
            some = letters[at : at + ASK]
            ids = np.array(self.tokenizer.encode(" ".join(words[k] for k in some), add_special_tokens=False).ids)
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(ends) == len(some):
                for k, piece in zip(some, np.split(ids, ends[:-1]), strict=True):
                    found[k] = piece.tolist()
            else:
                others += some
        for at in range(0, len(others), ASK):
            some = others[at : at + ASK]
            for k, one in zip(some, self.tokenizer.encode_batch_fast([words[k] for k in some], add_special_tokens=False), strict=True):
                found[k] = one.ids
        return np.array([len(x) for x in found], np.int32), np.array([i for x in found for i in x], np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts in a row, and the offsets of each text's ids."""
        raw, offsets = flat(column)
        first, last, bounds = word_bounds(raw, offsets)
        n_docs = len(column)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(n_docs + 1, np.int64)
        # A word of ASCII without '<' (which may begin a special token) has the ids of its lower-case form.
        odd = np.concatenate([[0], np.cumsum((raw >= 128) | (raw == 60), dtype=np.int64)])
        plain = odd[first] == odd[last]
        step = np.zeros(len(raw) + 1, np.int32)
        np.add.at(step, first[~plain], 1)
        np.add.at(step, last[~plain], -1)
        data = np.where(np.cumsum(step[:-1]) > 0, raw, lower(raw))
        # Marks that end a word after an ASCII letter are a piece of their own.
        low = lower(raw)
        solid = np.maximum.accumulate(np.where(_TAIL[raw], -1, np.arange(len(raw))))[last - 1]
        before = low[np.maximum(solid, 0)]
        cut = (solid >= first) & (solid < last - 1) & (before >= 97) & (before <= 122)
        n_cut = np.concatenate([[0], np.cumsum(cut)])
        head = np.arange(len(first)) + n_cut[:-1]
        begins, ends = np.empty(len(first) + n_cut[-1], np.int64), np.empty(len(first) + n_cut[-1], np.int64)
        begins[head], ends[head] = first, np.where(cut, solid + 1, last)
        begins[head[cut] + 1], ends[head[cut] + 1] = solid[cut] + 1, last[cut]
        first, last, bounds = begins, ends, bounds + n_cut[bounds]
        hashes = word_hashes(data, first, last)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != unique[inside]
        if new.any():
            blob = data.tobytes()
            if len(self.known) + int(new.sum()) > CACHE_WORDS or len(self.bytes) > CACHE_BYTES:
                self._forget()
                new[:] = True
            self._learn(unique[new], [blob[a:b] for a, b in zip(first[at[new]].tolist(), last[at[new]].tolist(), strict=True)])
            spot = np.searchsorted(self.known, unique)
        begin, count = self.begin[spot][back], self.count[spot][back].astype(np.int64)
        # Words of one fingerprint that differ: the library tells each.
        known = equal_words(data, first[at], last[at], self.bytes, self.first[spot], self.last[spot])
        other = np.flatnonzero(~(known[back] & equal_words(data, first, last, data, first[at][back], last[at][back])))
        ids = self.ids
        if len(other):
            n, parts = self._ask([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(first[other].tolist(), last[other].tolist(), strict=True)])
            begin[other], count[other] = len(ids) + np.cumsum(n, dtype=np.int64) - n, n
            ids = np.concatenate([ids, parts])
        ends = np.cumsum(count)
        index = np.arange(int(ends[-1])) - np.repeat(ends - count, count)
        starts = np.concatenate([[0], ends])
        return ids[np.repeat(begin, count) + index], starts[bounds]


_workers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer for a file."""
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each document."""
    n = len(offsets) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = offsets[1:] + np.arange(n)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = ids
    out[ends] = end
    return out, offsets + np.arange(n + 1)
