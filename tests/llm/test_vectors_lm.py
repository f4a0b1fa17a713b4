"""Embedding near-dedup and language-model scoring against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from sigloom.llm import embeddings, lm


def brute_links(rows, threshold=0.95):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = Counter()
    for k, (a, x) in enumerate(good):
        for b, y in good[k + 1 :]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                n[a] += 1
                n[b] += 1
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {(i, n[i], find(i), find(i) == i) for i, _ in rows if i is not None}


def test_links_and_components_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 60)
    rng = np.random.default_rng(2)
    rows = []
    for family in range(12):
        base = rng.normal(size=12)
        for _ in range(int(rng.integers(1, 60))):
            rows.append((base + rng.normal(size=12) * rng.choice([0.05, 0.12, 0.3]) * (family % 3 + 1) / 2).tolist())
    rows += [rows[0]] * 30 + [[2 * x for x in rows[0]]] + [None, [], [0.0] * 12, [1.0] * 3, [1.0] * 3, [1.0, None, 2.0], [float("nan")] * 12, [float("inf")] * 12]
    order = rng.permutation(len(rows))
    rows = [(int(i), v) for i, v in zip(order, rows, strict=True)]
    table = spark.createDataFrame([(i, v, 1, "e") for i, v in rows], "vec_id bigint, embedding array<double>, n int, rep string")
    found = embeddings.near_duplicates(table).collect()
    assert {tuple(r) for r in found} == brute_links(rows)
    assert embeddings.near_duplicates(table.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "vec_id bigint, embedding array<float>")
    assert sorted(map(str, map(tuple, embeddings.near_duplicates(odd).collect()))) == sorted(map(str, [(None, 0, None, True), (3, 1, 3, True), (3, 1, 3, True), (4, 0, 4, True)]))


def test_fixture_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    assert {tuple(r) for r in embeddings.near_duplicates(table).collect()} == brute_links(rows)


def split(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


class Plain:
    """The same model by dictionaries."""

    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        for text in texts:
            tokens = split(text)
            self.words.update(tokens)
            self.pairs.update(zip(["<s>", *tokens[:-1]], tokens, strict=True))
        self.total, self.after, self.before = Counter(), {}, Counter()
        for (a, b), c in self.pairs.items():
            self.total[a] += c
            self.after.setdefault(a, Counter())[min(c, 3)] += 1
            self.before[b] += 1
        of = lambda counts: lm.modified_discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])
        self.d, self.e = of(self.pairs), of(self.before)
        self.z = sum(self.before.values())
        self.rest = sum(self.e[min(c, 3) - 1] for c in self.before.values()) / self.z if self.z else 1

    def p(self, a, b):
        low = 1 / (len(self.words) + 1)
        if self.z:
            c = self.before[b]
            low = self.rest * low + (max(c - self.e[min(c, 3) - 1], 0) / self.z if c else 0)
        if not self.total[a]:
            return low
        c = self.pairs[a, b]
        rest = sum(n * self.d[k - 1] for k, n in self.after[a].items()) / self.total[a]
        return (max(c - self.d[min(c, 3) - 1], 0) / self.total[a] if c else 0) + rest * low


def brute_scores(rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    model = Plain([t for i, t in rows if not held[i]])
    n, v = sum(model.words.values()), len(model.words)
    out = {}
    for i, text in rows:
        tokens = split(text)
        base = sum(math.log10((model.words[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        score = sum(math.log10(model.p(a, b)) for a, b in zip(["<s>", *tokens[:-1]], tokens, strict=True))
        out[i] = (held[i], len(tokens), sum(model.words[t] > 0 for t in tokens), n, base, score)
    return out, model


def test_scores_are_those_of_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(lm, "FLUSH", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "The THE the new-word"), (9005, "a b " * 4000)], "doc_id bigint, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want, model = brute_scores(rows)
    found = lm.train_and_score(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert np.allclose([r.base_score, r.score], want[r.doc_id][4:], rtol=1e-9, atol=1e-9)
    # The probabilities of all words after a word, with one for unknown words, make one.
    for a in ["<s>", "the", "no such word"]:
        assert abs(sum(model.p(a, b) for b in [*model.words, "\0"]) - 1) < 1e-9


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.train_and_score(empty).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.train_and_score(spark.createDataFrame([(alone, "a b")], "doc_id bigint, text string")).first()
    assert r.held_out and r.n_tokens == 3 and r.n_known == r.train_tokens == 0 and r.score == 0
    null = lm.train_and_score(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id bigint, text string")).collect()
    assert all(not r.held_out and r.train_tokens == 6 for r in null)
