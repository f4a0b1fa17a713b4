"""Encoding by prefix tables against the library."""

import hashlib
import random

import numpy as np
import pytest

from sigloom.llm import pieces

PARTS = ["a", "e", "in", "▁", " ", "  ", "\n", "the", "token", "é", "日", "😀", "\x00", "<s>", "</s>", "<0x41>", "1", "2", "=", "{", "\t", "    ", "ing", "ation", "xxxxx", "‍", "ﬁ", "́", "\U0010ffff"]


@pytest.fixture(scope="module")
def table():
    return pieces.PieceTable(pieces.default_path())


def ids_of(table, text):
    return np.frombuffer(table.encode(text), "<i4").tolist()


def test_random_texts(table):
    rng = random.Random(3)
    plain = [i for i in range(table.size) if table.names[i] in table.ids]
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30)))
        assert ids_of(table, text) == table.library.encode(text), text
        text = "".join(table.names[rng.choice(plain)] for _ in range(rng.randint(1, 8)))
        assert ids_of(table, text) == table.library.encode(text), text


def test_tables_hold_the_last_piece_of_each_prefix(table):
    rng = random.Random(4)
    for _ in range(60):
        text = "▁" + "".join(rng.choice(PARTS[:20]) for _ in range(12)).replace(" ", "▁").replace("\n", "")
        last = table.prefix_table(text)
        for end in range(1, len(text)):
            assert last[end] == table.library.encode(text[1 : end + 1])[-1] or last[end] >= table.size


def test_pairs_are_those_that_the_library_leaves(table):
    rng = random.Random(5)
    plain = [i for i in range(3000) if table.names[i] in table.ids and not table.names[i].startswith("▁")]
    seen = set()
    for _ in range(4000):
        one, two = rng.choice(plain), rng.choice(plain)
        want = table.library.encode("\n" + table.names[one] + table.names[two])[2:] == [one, two]
        assert table.side_by_side(one, two) == want
        seen.add(want)
    assert seen == {True, False}


def test_long_text_without_blanks(table):
    rng = random.Random(6)
    text = "".join(rng.choice("etaoinshr日本語dlu") for _ in range(300_000))
    assert ids_of(table, text) == table.library.encode(text)


def test_what_is_remembered_is_bounded(monkeypatch):
    for name, most in (("STRETCHES", 20), ("WORDS", 10), ("PAIRS", 20)):
        monkeypatch.setattr(pieces, name, most)
    table = pieces.PieceTable(pieces.default_path())
    for k in range(300):
        text = f"word{k * 7919} and {chr(0x4E00 + k)}"
        assert ids_of(table, text) == table.library.encode(text)
        assert len(table.known) + len(table.known.before) <= 20 and len(table.words) + len(table.words.before) <= 10 and len(table.pairs) <= 20


def plain_report(library, doc_id, text):
    ids = library.encode(text or "", add_eos=True)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_all_documents_of_a_small_table(spark, table):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(plain_report(table.library, r.doc_id, r.text) for r in docs.collect())
    assert sorted(map(tuple, pieces.op13_sentencepiece(spark, "/root/testdata/sf0.001").collect())) == want


def test_odd_rows(spark, table):
    texts = [None, "", " ", "   two  blanks ", "\r\n", "▁ mark", "long " * 30_000, "same", "same"]
    rows = [(i, t) for i in (None, 1, 1, 2) for t in texts]
    docs = spark.createDataFrame([(i, t, [1], "p") for i, t in rows], "doc_id bigint, text string, ids array<int>, path string")
    assert sorted(map(str, map(tuple, pieces.report(docs).collect()))) == sorted(str(plain_report(table.library, *r)) for r in rows)
    assert pieces.report(docs.limit(0)).collect() == []
    again = pieces.decode(pieces.encode(docs.where("doc_id = 2"))).select("text").collect()
    assert sorted(r.text for r in again) == sorted(table.library.decode(table.library.encode(t or "")) for t in texts)
    assert {tuple(r.ids) for r in pieces.encode(docs.where("text = ''"), end=False).collect()} == {()}
    assert pieces.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")).select("text").distinct().collect() == [("",)]
