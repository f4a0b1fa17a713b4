"""Places asked of token files, extreme vectors, and texts full of passages."""

import numpy as np

from sigloom.llm import decontaminate, embeddings, tokenout
from sigloom.llm.store import new_folder
from tests.llm.test_dedup_tokens_packing import library_ids
from tests.llm.test_secrets_decontamination import brute_passages


def test_many_places_of_few_blocks_and_repeated_ids(spark):
    rows = [(None, f"null {i}") for i in range(40)] + [(7, f"seven {i}") for i in range(40)] + [(3, "three")] * 3 + [(i + 10, "a b c d " * i) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, tie string, part int")
    path = new_folder(spark, "t")
    tokenout.write_tokens(docs, path, block_ids=200)
    found = sorted(tokenout.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    want = {i: [*library_ids(t), 1] for i, t in rows if i is not None and i >= 10}
    every = {r.start + k: want[r.doc_id][k] for r in found if r.doc_id in want for k in range(r.n_tokens)}
    places = [*every, *list(every)[:50], None, -1, 10**9]
    asked = spark.createDataFrame([(p,) for p in places], "place bigint")
    assert sorted(map(tuple, tokenout.tokens_at(spark, path, asked).collect())) == sorted((p, every[p]) for p in places if p in every)


def test_vectors_whose_squares_leave_the_range(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [1e200, -1e200]), (6, [5e-324, 5e-324]), (7, [1e-170, -1e-170])]
    found = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(1, 4, 1), (2, 4, 1), (3, 4, 1), (4, 4, 1), (5, 1, 5), (6, 4, 1), (7, 1, 5)]


def test_steps_of_coordinates_lose_no_pair():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(200, 64))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.3, base[:50] * 3])
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    ones = np.ones(len(x), np.int64)
    n, _, edges = embeddings.compare(x, None, ones, ones, axes, 0.95)
    assert n.tolist() == want.tolist() and edges
    n, m, _ = embeddings.compare(x[:200], x[200:], ones[:200], ones[200:], axes, 0.95)
    assert n.tolist() == (unit[:200] @ unit[200:].T >= 0.95).sum(axis=1).tolist() and m.sum() == n.sum()


def test_texts_full_of_many_items(spark):
    word = [f"t{k}" for k in range(25)]
    items = [(i, " ".join(word[i : i + 12])) for i in range(13)] + [(50, "short item"), (51, "t1"), (None, "t2 t3"), (52, None), (50, "short item")]
    docs = [(1, " ".join(word * 6)), (2, "a short item here t1"), (3, None), (4, " ".join(word[:9])), (1, " ".join(word * 6)), (None, " ".join(word))]
    a = spark.createDataFrame([(i, t, "w", "k") for i, t in docs], "doc_id bigint, text string, words string, k string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted(map(str, map(tuple, decontaminate.report(a, b).collect())))
    assert set(found) == set(map(str, brute_passages(docs, [x for x in items if x[0] is not None], 10))) and len(found) == len(docs)
    few, decontaminate.BROADCAST_DOCS = decontaminate.BROADCAST_DOCS, 0
    try:
        assert sorted(map(str, map(tuple, decontaminate.report(a, b).collect()))) == found
    finally:
        decontaminate.BROADCAST_DOCS = few
