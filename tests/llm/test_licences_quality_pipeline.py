"""Licence scans, the two classifiers and the pipeline."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from sigloom.llm import licences, quality, toxicity
from tests.llm.test_dedup_tokens_packing import brute_components, odd
from tests.llm.test_secrets_decontamination import brute, brute_passages

SF = "/root/testdata/sf0.01"


def test_licences_are_named_and_unknowns_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    made = [(9001, "first\nReleased under the MIT License.\nlast"), (9002, None), (9003, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (9004, "He lost his driving license last year."), (9005, ""), (9001, "again under no licence")]
    docs = docs.union(spark.createDataFrame(made, "doc_id bigint, text string"))
    found = licences.scan(docs).collect()
    names = {"MIT License": "mit", "GNU General Public License": "gpl", "Apache License": "apache", "CC BY-NC": "cc-by-nc"}
    texts = docs.collect()
    assert len(found) == len(texts)
    want = sorted((r.doc_id, ",".join(sorted({f for n, f in names.items() if n in (r.text or "")}))) for r in texts)
    assert sorted((r.doc_id, r.families) for r in found) == want
    paragraphs = {(r.doc_id, sum(bool(re.search(r"[^\W_]", p)) for p in re.split(r"\n[ \t\r\x0b\x0c]*\n", r.text or ""))) for r in texts}
    assert {(r.doc_id, r.n_paragraphs) for r in found} == paragraphs
    assert licences.scan(docs.limit(0)).count() == 0


def test_quality_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in found.items())
    held = [(found[r.doc_id].predicted, r.quality) for r in labels.collect() if r.doc_id in found and found[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    assert quality.score(docs.limit(0), labels).count() == 0
    plain = quality.score(odd(spark), labels.limit(0)).collect()
    assert len(plain) == 11 and {r.score for r in plain} == {0.5}


def test_the_discriminant_is_the_difference_of_log_densities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (400, 3)), rng.normal(1.5, 0.5, (300, 3))])
    y = np.repeat([0, 1], [400, 300])
    parts = [x[y == k] for k in (0, 1)]
    model = quality.Discriminant(np.array([400.0, 300.0]), np.stack([p.sum(axis=0) for p in parts]), np.stack([p.T @ p for p in parts]))
    pooled = sum(np.cov(p.T, bias=True) * len(p) for p in parts) / 700
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for p in parts:
        s = (1 - quality.TO_POOLED - quality.TO_IDENTITY) * np.cov(p.T, bias=True) / np.outer(scale, scale) + quality.TO_POOLED * pooled / np.outer(scale, scale) + quality.TO_IDENTITY * np.eye(3)
        z = (x - p.mean(axis=0)) / scale
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z) - 0.5 * np.linalg.slogdet(s)[1])
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(logs[1] - logs[0] + np.log(300 / 400)))), atol=1e-6)


def test_convolution_gradients_and_learning():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(300)]
    y = np.arange(300) % 3 == 0
    texts = [t + " Rotten! egg" if bad else t for t, bad in zip(texts, y, strict=True)]
    model = toxicity.train(pa.array(texts), y.astype(np.float32), 0.3)
    buckets, bounds = toxicity.buckets_of(pa.array(["w1 w2 rotten w3", "w1 w2 w3", "", None]))
    scores = model.score(model.rows(buckets), bounds)
    assert scores[0] > 0.7 and max(scores[1:]) < 0.3
    model = toxicity.TextConvolution(np.arange(50))
    rows, edges = rng.integers(0, 51, 40), np.array([0, 7, 7, 25, 40])
    target = np.array([1, 0, 1, 0], np.float32)
    for name in model.p:
        model.p[name] = model.p[name].astype(np.float64)
    model.p["E"][:-1] = rng.normal(size=(50, toxicity.DIM))
    loss = lambda: float(np.mean(np.logaddexp(0, model.forward(rows, edges)) - target * model.forward(rows, edges)))
    g = model.gradients(rows, edges, target)
    for name in ("W2", "v", "E", "b3"):
        flat = model.p[name].reshape(-1)
        at = int(np.argmax(np.abs(g[name])))
        old, step = flat[at], 1e-3
        flat[at] = old + step
        up = loss()
        flat[at] = old - step
        down = loss()
        flat[at] = old
        assert abs((up - down) / (2 * step) - g[name].reshape(-1)[at]) < 2e-3


def test_toxicity_of_odd_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = toxicity.score(odd(spark), labels.limit(0)).collect()
    assert len(plain) == 11 and {r.score for r in plain} == {0.0} and not any(r.predicted for r in plain)
    assert toxicity.score(odd(spark).limit(0), labels).count() == 0


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_stages_keep_and_take_what_they_should(spark, docs):
    sf = "/root/testdata/sf0.001"
    kept = corpus_pipeline.minhash_near_dedup(spark, docs, sf)
    want = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()], 5) if i == c}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    clean = corpus_pipeline.benchmark_decontamination(spark, docs, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    some = [(r.doc_id, r.text) for r in docs.collect()][:40]
    bad = {r[0] for r in brute_passages(some, items, 10) if r[-1]}
    assert clean.columns == docs.columns and {i for i, _ in some} - {r.doc_id for r in clean.collect()} == bad
    redacted = {r.doc_id: r for r in corpus_pipeline.secret_scans(spark, docs, sf).collect()}
    for r in docs.collect():
        spans = brute(r.text)[4]
        assert (redacted[r.doc_id].text == r.text) == (spans == "") and redacted[r.doc_id].n_chars == len(redacted[r.doc_id].text)


def test_the_pipeline_packs_what_its_stages_kept(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert 0 < out["doc_id"].nunique() < 200 and out.groupby("sequence_id")["length"].sum().max() <= 2048
