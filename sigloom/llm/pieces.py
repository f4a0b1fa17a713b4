"""SentencePiece encoding by a prefix table, and decoding.

A merge model joins the two neighbouring symbols whose joint piece has the best score, again and again.  For every
prefix of a text exactly one piece can be the last of its encoding.  The table of these is filled from left to right: an
automaton names the pieces that end at a place, and the one that fits is the one that may stand next to the last piece
of the prefix before it.  Two pieces may stand side by side if merging their letters alone leaves just these two; the
answer for a pair is remembered.  The ids are then read off the table from its end, backwards.

Letters that never stand together inside a piece are never joined.  So a text falls into stretches, a word mark or several
and what follows, that are encoded on their own; short ones are remembered.  A model that has pieces with a mark after a
letter has its texts encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.textbatch import chunks

#: What stands for a blank in pieces.
MARK = "▁"
#: Stretches up to this many letters are remembered: so many words, other stretches, and answers about pairs.
SHORT, WORDS, STRETCHES, PAIRS = 48, 900_000, 200_000, 500_000


def default_path() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


class Remembered(dict):
    """Packed ids by stretch, made where they are missing.  When it is full it starts anew, and takes what is asked for
    again from what it held before."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, text: str) -> bytes:
        ids = self.before.get(text)
        if ids is None:
            ids = self.make(text)
            if len(text) > SHORT:
                return ids
        if len(self) >= self.most // 2:
            self.before = dict(self)
            self.clear()
        self[text] = ids
        return ids


class PieceTable:
    """The pieces of a merge model and the prefix tables of texts.

    Inside, a piece is its id; a letter that is no piece gets a number after all ids."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib = self.library
        self.size = lib.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: lib.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(self.size) if lib.is_byte(i)}
        self.unknown = next(i for i in range(self.size) if lib.is_unknown(i))
        self.lengths = [len(name) for name in self.names]
        self.letters: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.inside = {name[k : k + 2] for name in self.ids for k in range(len(name) - 1)}
        self.alone = not any(two[1] == MARK != two[0] for two in self.inside)
        self.stretches = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$" if self.alone else "(?s:.+)").findall
        self.known = Remembered(self.packed, STRETCHES)
        self.words = Remembered(lambda word: self.packed(MARK + word), WORDS)
        self.pairs: dict[int, bool] = {}
        self.merges: dict[int, list[tuple[float, str | None, str | None]] | None] = {}

    def letter(self, text: str) -> int:
        found = self.ids.get(text, self.letters.get(text))
        if found is None:
            found = self.letters[text] = len(self.names)
            self.names.append(text)
            self.lengths.append(1)
        return found

    def history(self, piece: int) -> list[tuple[float, str | None, str | None]] | None:
        """The merges that make a piece of its letters, in their order: the score and, where the merge changes it, the
        first and the last symbol.  None where merging doesn't end in the piece."""
        if piece not in self.merges:
            symbols, out = list(self.names[piece]), []
            while len(symbols) > 1:
                scored = [(self.scores.get(a + b), -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))]
                best = max((s for s in scored if s[0] is not None), default=None)
                if best is None:
                    break
                k = -best[1]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
                out.append((best[0], symbols[0] if k == 0 else None, symbols[-1] if k == len(symbols) - 1 else None))
            self.merges[piece] = out if len(symbols) == 1 else None
        return self.merges[piece]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging the letters of both, together, leaves the two pieces."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 21 | right] = self._side_by_side(left, right)
        return found

    def _side_by_side(self, left: int, right: int) -> bool:
        """Both are merged at once in the order of scores; they don't stay apart if their touching symbols join before
        either has its next merge."""
        one, two = self.history(left), self.history(right)
        if one is None or two is None:
            return False
        low = -float("inf")
        last, first, i, j = self.names[left][-1], self.names[right][0], 0, 0
        while True:
            join = self.scores.get(last + first)
            own, other = one[i][0] if i < len(one) else low, two[j][0] if j < len(two) else low
            # Equal scores: what stands further left goes first.
            if join is not None and join > own and join >= other:
                return False
            if i == len(one) and j == len(two):
                return True
            if own >= other and i < len(one):
                last = one[i][2] or last
                i += 1
            else:
                first = two[j][1] or first
                j += 1

    def prefix_table(self, text: str) -> list[int]:
        """The last piece of the encoding of each prefix; where no piece fits, it is the letter."""
        last, done = [0] * len(text), -1
        known, lengths = self.pairs.get, self.lengths
        for end, piece in self.automaton.iter(text):  # places rise, and at each place the longest piece comes first
            if end == done:
                continue  # the piece that fits there is found
            while done < end - 1:
                done += 1
                last[done] = self.letter(text[done])
            before = end - lengths[piece]
            if before >= 0:
                fits = known(last[before] << 21 | piece)
                if fits is None:
                    fits = self.side_by_side(last[before], piece)
            else:
                fits = self.history(piece) is not None
            if fits:
                last[end] = piece
                done = end
        for at in range(done + 1, len(text)):
            last[at] = self.letter(text[at])
        return last

    def of_stretch(self, text: str) -> list[int]:
        """Ids of a stretch: the table is read from its end."""
        last, found, at = self.prefix_table(text), [], len(text) - 1
        while at >= 0:
            found.append(last[at])
            at -= self.lengths[last[at]]
        found.reverse()
        if max(found) < self.size:
            return found
        out: list[int] = []
        for piece in found:
            if piece < self.size:
                out.append(piece)
            elif self.bytes:
                out += [self.bytes[b] for b in self.names[piece].encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)  # neighbouring unknown letters are one unknown piece
        return out

    def packed(self, text: str) -> bytes:
        """Ids of a stretch, four bytes each.  Where two letters never stand together inside a piece, what is left and
        right of them is encoded on its own."""
        inside = self.inside
        # Words of letters alone are seldom cut; without bytes, unknown letters side by side are one id.
        if self.bytes and not text[1:].isalpha():
            cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in inside]
            if cuts:
                return b"".join([self.known[text[a:b]] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)])
        return array("i", self.of_stretch(text)).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as the library gives them, four bytes each; the library makes the text ready, with its blanks
        marked."""
        ready = self.library.normalize(text)
        if self.alone and ready[:1] == MARK and ready[-1] != MARK and MARK + MARK not in ready:
            return b"".join(map(self.words.__getitem__, ready[1:].split(MARK)))  # one mark and a word each
        return b"".join(map(self.known.__getitem__, self.stretches(ready)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The worker's own table of a model: it is made once."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encode(docs: DataFrame, path: str | None = None, end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every row of ``docs`` (doc_id, text), by the model at ``path`` on every machine; with
    ``decoded`` also ``text``, what decoding these ids gives.

    Null and empty texts have the end id alone (none without ``end``).  Repeated rows are encoded each; rows with a null
    doc_id like others; further columns are left out, whatever their names; an empty table gives no rows.  A text is one
    task's work, linear in its length.
    """
    model = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        tail = np.array([table.library.eos_id()] if end else [], "<i4").tobytes()
        for batch in chunks(batches):
            rows = [table.encode(t or "") + tail for t in batch.column(1).to_pylist()]
            offsets = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
            flat = np.frombuffer(b"".join(rows), "<i4")
            columns, names = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"]
            if decoded:
                columns.append(pa.array([table.decode(np.frombuffer(r, "<i4").tolist()) for r in rows], pa.string()))
                names.append("text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>" + ", text string" * decoded)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and text of every row of ``tokens`` (doc_id, ids); null ids are an empty text."""
    model = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model)
        for batch in batches:
            ids = batch.column(1)
            texts = [table.decode(r or []) for r in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids array<int>, text string")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The number of ids, and digests of the ids and of the decoded text."""
    found = encode(docs, path, decoded=True)
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2(F.col("text"), 256).alias("decoded_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes all ``documents``."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
