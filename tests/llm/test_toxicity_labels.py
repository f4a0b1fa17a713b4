"""Toxicity: held-out rows, thresholds by language, and rows that are odd."""

import zlib

import numpy as np
import pytest

from sigloom.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(found[r.doc_id].score, r.toxic) for r in labels.collect() if found[r.doc_id].held_out]
    ones, zeros = ([s for s, y in held if y == k] for k in (1, 0))
    auc, recall, precision = np.mean([a > b for a in ones for b in zeros]), np.mean([s >= 0.3 for s in ones]), np.sum(np.array(ones) >= 0.3) / max(1, sum(s >= 0.3 for s, _ in held))
    print(f"toxicity, held out: {len(held)} rows, AUC {auc:.3f}, precision {precision:.3f}, recall {recall:.3f}")
    assert auc > 0.95 and recall > 0.8 and precision > 0.85  # about a tenth of the toxic rows hold no telling word


def test_thresholds_are_those_of_plain_counts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for lang, n, shift in (("a", 150, 0.1), ("b", 400, 0.3), ("c", 50, 0.0), (None, 60, 0.2), ("one", 200, 0.0)):
        for _ in range(n):
            y = int(rng.random() < 0.3) if lang != "one" else 0
            rows.append((lang, int(np.clip(rng.normal(300 + 1000 * shift + 300 * y, 150), 0, 999)), y))

    def best(some):
        cuts = {b: 2 * sum(y for _, x, y in some if x >= b) / (sum(x >= b for _, x, _ in some) + sum(y for *_, y in some)) for b in {x for _, x, _ in some}}
        return max(cuts, key=lambda b: (cuts[b], b))

    found = {r.lang: r.cut for r in toxicity.thresholds(spark.createDataFrame(rows, "lang string, bin bigint, y int")).collect()}
    assert found == {None: best(rows), "a": best([r for r in rows if r[0] == "a"]), "b": best([r for r in rows if r[0] == "b"])}


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, f"w{i % 7} w{i % 11} " + ("rotten egg" if i % 3 == 0 else "fresh egg") + f" w{i % 5}", "en", 1, 2.0) for i in range(400)]
    rows += [(3, "another text", "en", 1, 2.0), (3, "another text", "en", 1, 2.0), (None, "rotten egg", None, 1, 2.0), (500, None, "en", 1, 2.0), (501, "", "en", 1, 2.0), (502, "rotten " * 30000, "en", 1, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, y int, score double")
    marks = [(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(400)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1), (600, 1, 1), (7, None, None)]
    return docs, spark.createDataFrame(marks, "doc_id bigint, toxic int, quality int")


def test_odd_rows_of_both_classifiers(small):
    docs, labels = small
    for found, n in ((toxicity.score(docs, labels).collect(), 406), (quality.score(docs, labels).collect(), 406)):
        assert len(found) == n and all(0 <= r.score <= 1 for r in found)
        assert [r.held_out for r in found if r.doc_id is None] == [False]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect() if r.doc_id is None or r.doc_id > 3}
    assert scores[None] > 0.3 and scores[502] > 0.3 and scores[4] < 0.3


def test_the_sample_is_bounded_and_holds_one_text_of_an_id(small, monkeypatch):
    docs, labels = small
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg({"toxic": "min"}).withColumnRenamed("min(toxic)", "y")
    monkeypatch.setattr(toxicity, "SAMPLE", 50)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    table = toxicity.sample(docs, marked)
    ids = table.column("doc_id").to_pylist()
    assert len(set(ids)) == len(ids) <= 100 and 800 < sum(len(t) for t in table.column("text").to_pylist()) <= 1000
