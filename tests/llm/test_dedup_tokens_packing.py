"""Near-duplicates, token files and packing against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row

from sigloom.llm import dac, minhash, packing, tokenout
from sigloom.llm.store import new_folder
from sigloom.llm.tokens import default_path

ODD = ["", None, " \t\n", "one", "One", "a b", "A  B", "x " * 3000 + "end", "Don't STOP. <|endoftext|> 9,9. é́ İ.", "a b", "𝒳 𝒴 ß."]


def odd(spark):
    rows = [Row(doc_id=i, text=t, extra="e", n_shingles=7) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, extra string, n_shingles int")


def brute_components(rows, words, percent=80):
    def shingles(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        if not found:
            return frozenset()
        return frozenset([tuple(found)] if len(found) < words else zip(*(found[k:] for k in range(words)), strict=False))

    sets = {d: shingles(t) for d, t in rows}
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    parent[y] = x
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_those_of_brute_force(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=words).collect()}
    assert found == brute_components([(r.doc_id, r.text) for r in docs.collect()], words)


def test_chains_and_buckets_of_several_components(spark):
    """Texts of 100 words, each some words away from the next: links in chains, no star finds them all."""
    rng = np.random.default_rng(3)
    texts = []
    for _family in range(4):
        base = [f"w{int(x)}" for x in rng.integers(0, 10**6, 100)]
        for _copy in range(25):
            base = list(base)
            for at in rng.integers(0, 100, 4):
                base[int(at)] = f"v{int(rng.integers(0, 10**6))}"
            texts.append(" ".join(base))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()}
    assert found == brute_components(rows, 2)


def test_sketches_fill_and_agree_like_the_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (minhash.sketch(a) != np.iinfo(np.uint64).max).all()
    shared, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    same = (minhash.sketch(np.concatenate([shared, one])) == minhash.sketch(np.concatenate([shared, two]))).mean()
    assert abs(same - 0.8) < 0.1


def test_near_duplicates_of_odd_and_no_rows(spark):
    found = {r.doc_id: r for r in minhash.near_duplicates(odd(spark), words=2).collect()}
    assert found[5].component_id == found[9].component_id == found[6].component_id == 5
    assert found[4].component_id == 3 and not found[4].kept
    assert all(found[i].n_shingles == 0 and found[i].kept for i in (0, 1, 2))
    assert minhash.near_duplicates(odd(spark).limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id bigint, text string")
    assert sorted(str(r.component_id) for r in minhash.near_duplicates(repeated, words=2).collect()) == ["1", "1", "1", "None"]


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path()).encode(text or "", add_special_tokens=False).ids


def test_codes_give_any_id():
    for n in (0, 1, 7, 512, 513, 5000):
        ids = np.random.default_rng(n).choice([0, 255, 256, 65535, 65536, 2**32 - 1], n).astype(np.uint32)
        block = dac.Block(dac.encode(ids))
        assert (block.decode() == ids).all()
        assert [block.get(i) for i in range(0, n, 37)] == ids[::37].tolist()


def test_token_files_hold_the_library_s_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd(spark).selectExpr("doc_id + 100000", "text"))
    path = new_folder(spark, "t")
    tokenout.write_tokens(docs, path, block_ids=5000)
    found = sorted(map(tuple, tokenout.read_documents(spark, path).collect()))
    want, start, every = [], 0, []
    for doc_id, text in sorted(map(tuple, docs.collect())):
        ids = [*library_ids(text), 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
        every += ids
    assert found == want
    places = spark.createDataFrame([(i,) for i in [0, 1, 4999, 5000, start - 1, start, None]], "place bigint")
    assert sorted(map(tuple, tokenout.tokens_at(spark, path, places).collect())) == [(i, every[i]) for i in (0, 1, 4999, 5000, start - 1)]
    path = new_folder(spark, "t")
    tokenout.write_tokens(docs.limit(0), path)
    assert tokenout.read_documents(spark, path).count() == 0


def test_packing_holds_every_piece_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd(spark).selectExpr("doc_id + 100000", "text"))
    rows = packing.pack(docs, capacity=512).toPandas()
    want = set()
    for doc_id, text in docs.collect():
        ids = np.array([*library_ids(text), 0], "<u4")
        want |= {(doc_id, k, at, len(ids[at : at + 512]), zlib.crc32(ids[at : at + 512].tobytes())) for k, at in enumerate(range(0, len(ids), 512))}
    assert set(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want and len(rows) == len(want)
    for _, one in rows.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one["offset"].tolist() == [0, *one["length"].cumsum()[:-1]] and one["length"].sum() <= 512
    lengths = rows["length"].to_numpy()
    assert rows["sequence_id"].nunique() <= packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), np.full(len(lengths), -1), 512).max() + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_evolution_beats_or_meets_best_fit():
    rng = np.random.default_rng(5)
    lengths = rng.integers(20, 70, 300)
    none = np.full(300, -1)
    first = packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), none, 100)
    best, bred = packing.evolve(lengths, 100, 2, [])
    assert bred and not packing.evolve(np.full(10, 10), 100, 2, [])[1]
    elite = packing.evolve(lengths, 100, 2, [(best, True)])
    assert packing.fitness(lengths, elite[0], 100) <= packing.fitness(lengths, best, 100)
    assert np.bincount(best, weights=lengths).max() <= 100
    assert packing.fitness(lengths, best, 100) <= packing.fitness(lengths, first, 100)


def check_packing(rows, docs, capacity):
    want = Counter()
    for doc_id, text in docs:
        ids = np.array([*library_ids(text), 0], "<u4")
        want.update((doc_id, k, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for k, at in enumerate(range(0, len(ids), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= capacity
    return len(bins)


def test_many_groups_repeated_rows_and_migrants(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = np.random.default_rng(4)
    rows = [(int(i), "word " * int(n)) for i, n in enumerate(rng.integers(20, 70, 150))] + [(7, "same row " * 12)] * 100 + [(None, None), (None, "x"), (3, ""), (3, "a b " * 200)]
    docs = spark.createDataFrame([(i, t, "g", 1, 2) for i, t in rows], "doc_id bigint, text string, grp string, bin int, deal int")
    found = packing.pack(docs, capacity=100).collect()
    n = check_packing(found, rows, 100)
    assert n <= 1.15 * sum(r.length for r in found) / 100 + 8 and any(r.bred for r in found)
    dealt = packing._grouped(packing.cut_pieces(docs.where("doc_id = 7"), 100, packing.default_path(), 0), 100, 1)
    assert dealt.select("grp").distinct().count() == 3  # rows alike go to all groups


def test_ids_of_sequences_differ_in_group_bin_and_pass(spark, monkeypatch):
    monkeypatch.setattr(packing, "MOST_BINS", 4)
    bins = spark.sql("select grp, bin from range(40) lateral view explode(sequence(0, 3)) b as bin lateral view explode(array(id)) g as grp")
    ids = bins.select(packing.sequence_id(0).alias("x")).union(bins.select(packing.sequence_id(1).alias("x")))
    assert ids.distinct().count() == ids.count() == 320
    docs = spark.createDataFrame([(i, "word " * 80) for i in range(9)], "doc_id bigint, text string")
    with pytest.raises(Exception, match="more than 4 bins"):
        packing.pack(docs, capacity=100).collect()
