"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from sigloom.llm import periodic


def plain_runs(words):
    """Every run, by looking at each period and each word."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(12, 2 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts_of_words():
    rng = random.Random(11)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, list("ab") * 40, list("aab" * 7) + list("c") + list("aab" * 9)]
    for _ in range(150):
        out.append([rng.choice("ab" if rng.random() < 0.5 else "abcdef") for _ in range(rng.randint(0, 120))])
    for _ in range(60):  # repeated passages of every size, nested, cut and with single words changed
        words = []
        while len(words) < rng.randint(10, 500):
            passage = [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 90))]
            if rng.random() < 0.4:
                passage = passage[: rng.randint(1, 6)] * rng.randint(1, 9)
            words += (passage * rng.randint(1, 5))[: rng.randint(1, 400)]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "x"
        out.append(words)
    return out


def test_runs_are_those_of_a_plain_search():
    for words in texts_of_words():
        ids = periodic.number_words([w.encode() for w in words])
        assert periodic.find_runs(ids) == plain_runs(words), words


def test_small_blocks_lose_no_run(monkeypatch):
    monkeypatch.setattr(periodic, "LEAST_BLOCK", 8)
    every = [periodic.find_runs(periodic.number_words([w.encode() for w in words])) for words in texts_of_words()]
    monkeypatch.setattr(periodic, "LEAST_BLOCK", 16)
    assert every == [periodic.find_runs(periodic.number_words([w.encode() for w in words])) for words in texts_of_words()]


@pytest.mark.parametrize("words", [["a"] * 400_000, ["a", "b", "c"] * 100_000 + ["d"] + ["a", "b"] * 100_000, [f"w{k}" for k in range(150_000)] * 3])
def test_very_long_texts_end_soon(words):
    began = time.time()
    runs = periodic.find_runs(periodic.number_words([w.encode() for w in words]))
    assert time.time() - began < 60 and 1 <= len(runs) <= 3


def plain_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    exponent = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc_id, len(runs), *top, exponent, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)), n)


def test_report_of_all_documents_of_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "array_join(slice(split(text, ' '), 1, 400), ' ') as text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = sorted(map(tuple, periodic.report(periodic._repeated(docs)).collect()))
    assert found == sorted(plain_report(*r) for r in rows)
    assert sum(r[1] > 0 for r in found) > 10


def test_odd_rows(spark):
    odd = "a b  x\x1cy\x85z "
    rows = [(i, t) for i in (None, 0, 3, 7, 21, 21, -5, 2**62) for t in (None, "", " \t\n", "one", odd * 9, "é日本 " * 40, "x y z\n" * 30)]
    docs = spark.createDataFrame([(i, t, "r", 1, "w") for i, t in rows], "doc_id bigint, text string, runs string, n_words int, w string")
    found = sorted(map(str, map(tuple, periodic.report(periodic._repeated(docs)).collect())))
    assert found == sorted(map(str, (plain_report(*r) for r in rows)))
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60))
    assert periodic.report(periodic._repeated(docs.limit(0))).collect() == []


def test_collapsed_text_and_runs_are_given(spark):
    docs = spark.createDataFrame([(1, "start " + "a b c " * 6 + "end")], "doc_id bigint, text string")
    (r,) = periodic.periodic_runs(docs).collect()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (20, [(1, 18, 3)], "start a b c end")


def test_agreeing_places():
    ids = np.array([0, 1, 0, 1, 2, 1])
    assert periodic.agreeing(periodic.bit_planes(ids), 6, 2) == 0b1011
