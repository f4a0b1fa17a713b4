"""Words are told apart by their bytes: words that simple fingerprints take for one, and fingerprints that are all one."""

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import lm, minhash, tokens
from sigloom.llm.textbatch import equal_words, flat, word_bounds, word_hashes
from tests.llm.test_dedup_tokens_packing import brute_components, library_ids


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


PAIRS = [thue_morse(n) for n in (8, 64, 128, 1024, 2048)]


def test_fingerprints_of_thue_morse_words_differ():
    text = " ".join(w for pair in PAIRS for w in pair)
    data, offsets = flat(pa.array([text]))
    first, last, _ = word_bounds(data, offsets)
    for seed in (0, 5):
        assert len(set(word_hashes(data, first, last, seed).tolist())) == 2 * len(PAIRS)
    assert set(word_hashes(data, first, last, 0).tolist()).isdisjoint(word_hashes(data, first, last, 5).tolist())
    same = equal_words(data, first, last, data, np.roll(first, 1), np.roll(last, 1))
    assert not same.any() and equal_words(data, first, last, data, first, last).all()


def test_equal_words_sees_every_byte():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("ab"), int(n))) for n in rng.integers(1, 40, 300)]
    data, offsets = flat(pa.array([" ".join(words)]))
    first, last, _ = word_bounds(data, offsets)
    order = rng.permutation(len(words))
    found = equal_words(data, first, last, data, first[order], last[order])
    assert found.tolist() == [words[k] == words[order[k]] for k in range(len(words))]


@pytest.mark.parametrize("one_fingerprint", [False, True])
def test_ids_of_words_that_share_a_fingerprint(monkeypatch, one_fingerprint):
    if one_fingerprint:
        monkeypatch.setattr(tokens, "word_hashes", lambda data, first, last: np.full(len(first), 7, np.uint64))
    tokenizer = tokens.WordTokenizer(tokens.default_path())
    texts = [w for pair in PAIRS for w in pair] + ["One two three. One", "é ß <|x|> it's", "", None, "two"]
    for _ in range(2):
        ids, offsets = tokenizer.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [library_ids(t) for t in texts]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    ids, offsets = tokenizer.encode(pa.array(texts[::-1]))
    assert ids[: offsets[1]].tolist() == library_ids("two")


def test_near_duplicates_and_counts_keep_such_words_apart(spark):
    one, other = PAIRS[3]
    rows = [(1, f"{one} x"), (2, f"{other} x"), (3, f"{one} x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=2).collect()}
    assert found == brute_components(rows, 2) == {(1, 1, 1), (2, 1, 2), (3, 1, 1)}
    model = lm.train(docs)
    assert model.words == 4 and model.tokens == 9


def test_hot_centres_and_buckets(spark, monkeypatch):
    """Groups far above the number from which a key counts as hot."""
    monkeypatch.setattr("sigloom.llm.joins.HOT", 4)
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.integers(0, 120, 5):
            words[int(at)] = f"v{i}-{int(at)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[0][1]) for i in range(30)] + [(200 + i, f"alone {i} {i + 1}") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=2).collect()}
    assert found == brute_components(rows, 2)


def test_rows_that_share_an_id_link_by_each_of_their_texts(spark):
    rows = [(1, "w1 w2 w3 w4 w5 w6"), (1, "v1 v2 v3 v4 v5 v6"), (2, "v1 v2 v3 v4 v5 v6"), (3, "w1 w2 w3 w4 w5 w6")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(1, 1), (1, 1), (2, 1), (3, 1)]
