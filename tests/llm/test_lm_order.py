"""The trigram model of op10_lm_scoring against dictionaries."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sigloom.llm import lm
from tests.llm.test_vectors_lm import split


class Plain:
    """Modified Kneser-Ney of order 3 by dictionaries; bigrams at a text's start count their occurrences."""

    def __init__(self, texts):
        self.words, pairs, self.three = Counter(), Counter(), Counter()
        for text in texts:
            tokens = split(text)
            self.words.update(tokens)
            row = ["<s>", *tokens]
            pairs.update(zip(row, tokens))
            self.three.update(zip(row, row[1:], row[2:]))
        before = Counter((b, c) for _, b, c in self.three)
        self.two = Counter({x: n if x[0] == "<s>" else before[x] for x, n in pairs.items()})
        self.one = Counter(b for _, b in pairs)
        of = lambda counts: lm.modified_discounts([sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])
        self.d = {1: of(self.one), 2: of(self.two), 3: of(self.three)}
        self.after = {}
        for counts in (self.two, self.three):
            for gram, c in counts.items():
                self.after.setdefault(gram[:-1], []).append(c)
        self.after[()] = list(self.one.values())
        rest = lambda context, after: sum(self.d[len(context) + 1][min(n, 3) - 1] for n in after)
        self.after = {context: (sum(after), rest(context, after)) for context, after in self.after.items() if after}

    def p(self, context, word):
        counts = {0: self.one, 1: self.two, 2: self.three}[len(context)]
        low = self.p(context[1:], word) if context else 1 / (len(self.words) + 1)
        if context not in self.after:
            return low
        total, rest = self.after[context]
        d = self.d[len(context) + 1]
        c = counts[(*context, word) if context else word]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total + rest / total * low


def test_query_scores_are_those_of_trigram_dictionaries(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lm, "FLUSH", 3000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(9001, None), (9002, ""), (9003, " \n"), (9004, "The THE the new-word"), (9005, "a b " * 4000), (9006, "a b c a b d x y")], "doc_id bigint, text string"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    model = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1])
    found = {r.doc_id: r for r in lm.op10_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        row = ["<s>", *split(text)]
        want = sum(math.log10(model.p(tuple(row[max(0, k - 2) : k]), row[k])) for k in range(1, len(row)))
        assert np.isclose(found[i].score, want, rtol=1e-9, atol=1e-9)
    for context in [("<s>",), ("a", "b"), ("of", "the"), ("no such", "word")]:
        assert abs(sum(model.p(context, w) for w in [*model.words, "\0"]) - 1) < 1e-9


def test_a_known_order_gives_context_beyond_one_word(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:40]
    texts = [(i, "p m q" if k % 2 else "r m s") for k, i in enumerate(learnt)] + [(held, "p m q"), (held, "p m s")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    scores = lambda order: [r.score for r in lm.train_and_score(docs, order).where("held_out").orderBy("score").collect()]
    low, high = scores(2)
    assert math.isclose(low, high)
    low, high = scores(3)
    assert high - low > 0.5
    with pytest.raises(ValueError):
        lm.train(docs, 4)


def test_nothing_to_learn_from_at_order_three(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.train_and_score(empty, 3).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert lm.train_and_score(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string"), 3).first().score == 0
    null = lm.train_and_score(spark.createDataFrame([(None, ""), (None, None)], "doc_id bigint, text string"), 3).collect()
    assert len(null) == 2 and all(r.train_tokens == 2 for r in null)


def test_counts_beyond_32_bits_keep_their_width(tmp_path):
    for counts in ([1, 2, 3], [1, 2**33, 3], []):
        lm._write(str(tmp_path), f"c{len(counts)}-{max(counts, default=0)}", lm._narrow(np.array(counts, np.uint64)))
        found = lm.Model(str(tmp_path))._counts(f"c{len(counts)}-{max(counts, default=0)}", 0, len(counts))
        assert found.tolist() == counts


def test_keys_that_leave_64_bits_are_refused():
    words = 3 * 10**8
    lm.fits(words + 1, words)  # bigrams
    lm.fits(4 * 10**6, words)  # trigrams of a shard
    with pytest.raises(OverflowError):
        lm.fits(10**11, words)
    model = lm.Model("", word_sizes=[words])
    keys = model.trigram_keys(np.array([0, 1, 4 * 10**6, 5 * 10**10]), np.array([words - 1, 0, 7, 9]))
    assert [int(k) for k in keys] == [words - 1, words + 1, 4 * 10**6 * (words + 1) + 7, 5 * 10**10 * (words + 1) + 9]


def test_equal_keys_of_different_shards_are_counted_apart():
    keys, shard = np.array([5, 5, 5, 7, 5], np.uint64), np.array([0, 3, 0, 3, 3])
    rows = lm._sums_in_shards(keys, shard).to_pylist()
    assert [(r["shard"], lm._unpack(r["a"]).tolist(), lm._unpack_counts(r["b"]).tolist()) for r in rows] == [(0, [5], [2]), (3, [5, 7], [2, 1])]
