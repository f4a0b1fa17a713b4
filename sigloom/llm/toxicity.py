"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

Words fall into hash buckets; the buckets met often enough, and unevenly in the two labels, have embeddings (others: zeros).
Filters of several widths slide over the words of a text, and each filter's largest response goes into a logistic
output.  The model is fitted on a bounded sample of labelled rows (SAMPLE of each label and SAMPLE_BYTES of whole texts,
by hash of the id) and scores every whole text.  A threshold for each language is calibrated on all labelled rows of a
fold that the fit never sees, by counts of their scores that Spark adds up; languages with too few take that of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigloom.llm.quality import fold_of
from sigloom.llm.store import keep
from sigloom.llm.textbatch import chunks, flat, lower, mix, word_bounds, word_hashes

#: Labelled rows of each kind that the fit may use at most, and bytes of their texts, which are whole.
SAMPLE, SAMPLE_BYTES = 2_500, 48_000_000
#: One labelled row of so many calibrates the thresholds; scores are counted in so many bins.
KEPT_OUT, BINS = 10, 1_000
BUCKETS, ROWS, DIM, WIDTHS, FILTERS = 1 << 22, 1 << 14, 8, (1, 2, 3), 8
#: Training texts that a bucket must be met in, and how many standard errors its shares in the two labels must differ.
LEAST_TEXTS, LEAST_Z = 3, 3.0
EPOCHS, BATCH, RATE, DECAY, INIT, CROPPED = 12, 64, 0.02, 1e-4, 0.1, 0.3
FLAG = 0.3
#: Rows of a language that its own threshold takes.
LEAST_ROWS = 100

#: Marks around a word that don't belong to it.
_TRIM = np.zeros(256, bool)
_TRIM[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def buckets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each lower-case word without the marks around it, and the first word of each text."""
    data, offsets = flat(column)
    data = lower(data)
    first, last, bounds = word_bounds(data, offsets)
    if not len(first):
        return np.zeros(0, np.int64), bounds
    place = np.arange(len(data))
    ends = np.maximum.accumulate(np.where(_TRIM[data], -1, place))[last - 1] + 1
    begins = np.minimum.accumulate(np.where(_TRIM[data], len(data), place)[::-1])[::-1][first]
    bare = (ends > first) & (begins < ends)
    first, last = np.where(bare, begins, first), np.where(bare, ends, last)
    return (mix(word_hashes(data, first, last)) % np.uint64(BUCKETS)).astype(np.int64), bounds


def buckets_in_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for a column that is long: part by part, as the byte-wise steps need many times its size."""
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    buckets, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in chunks(iter([batch]), size=500_000):
        found, bounds = buckets_of(part.column(0))
        buckets.append(found)
        counts.append(np.diff(bounds))
    return np.concatenate(buckets), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


class TextConvolution:
    def __init__(self, known: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.known = known
        self.p = {"E": rng.normal(0, INIT, (len(known) + 1, DIM)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["v"] = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)
        self.p["E"][-1] = 0
        self.shift = 0.0

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        """Rows of E; the last, of zeros, for buckets without embedding."""
        if not len(self.known):
            return np.zeros(len(buckets), np.int64)
        at = np.minimum(np.searchsorted(self.known, buckets), len(self.known) - 1)
        return np.where(self.known[at] == buckets, at, len(self.known))

    def _windows(self, rows: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """For each offset in a window, the row of the word there; zeros beyond a text's end."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        place = np.arange(len(rows))
        padded = np.concatenate([rows, np.full(max(WIDTHS), len(self.known))])
        return [np.where(place + j < ends, padded[place + j], len(self.known)) for j in range(max(WIDTHS))]

    def forward(self, rows: np.ndarray, bounds: np.ndarray, keep: bool = False):
        texts = np.flatnonzero(np.diff(bounds) > 0)
        n = len(bounds) - 1
        pooled = np.zeros((n, FILTERS * len(WIDTHS)), np.float32)
        where = np.zeros((n, FILTERS * len(WIDTHS)), np.int64)
        shifted = self._windows(rows, bounds) if len(rows) else []
        for k, w in enumerate(WIDTHS):
            if not len(texts):
                break
            out = np.repeat(self.p[f"b{w}"][None, :], len(rows), axis=0)
            for j in range(w):
                out += (self.p["E"] @ self.p[f"W{w}"][j])[shifted[j]]
            span = slice(k * FILTERS, (k + 1) * FILTERS)
            pooled[texts, span] = np.maximum(np.maximum.reduceat(out, bounds[:-1][texts], axis=0), 0)
            if keep:
                for t in texts:
                    where[t, span] = bounds[t] + out[bounds[t] : bounds[t + 1]].argmax(axis=0)
        margin = pooled @ self.p["v"] + self.p["c"][0]
        return (margin, pooled, where, shifted) if keep else margin

    def score(self, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        margin = self.forward(rows, bounds).astype(float) + self.shift
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def gradients(self, rows: np.ndarray, bounds: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        margin, pooled, where, shifted = self.forward(rows, bounds, keep=True)
        error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30)))) - y) / len(y)
        g = {name: np.zeros_like(value) for name, value in self.p.items()}
        g["v"], g["c"][0] = pooled.T @ error, error.sum()
        back = error[:, None] * self.p["v"][None, :] * (pooled > 0)
        for k, w in enumerate(WIDTHS):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = part.sum(axis=0)
            text, filter_ = np.nonzero(part)
            value, spot = part[text, filter_], where[text, k * FILTERS + filter_]
            for j in range(w):
                row = shifted[j][spot]
                np.add.at(g[f"W{w}"][j].T, filter_, self.p["E"][row] * value[:, None])
                np.add.at(g["E"], row, self.p[f"W{w}"][j].T[filter_] * value[:, None])
        g["E"][-1] = 0
        return g


def train(texts: pa.Array, labels: np.ndarray, share: float, seed: int = 11) -> TextConvolution:
    """Fits the network; ``share`` is label 1's share of all labelled rows, which the balanced sample doesn't show."""
    buckets, bounds = buckets_in_parts(texts)
    doc = np.repeat(np.arange(len(labels)), np.diff(bounds))
    pairs = np.unique(doc * np.int64(BUCKETS) + buckets)
    pairs = pairs % BUCKETS, pairs // BUCKETS
    found, back, counts = np.unique(pairs[0], return_inverse=True, return_counts=True)
    ones = np.bincount(back, weights=labels[pairs[1]], minlength=len(found))
    n, n1 = len(labels), float(labels.sum())
    n0 = max(n - n1, 1.0)
    p = counts / n
    z = np.abs(ones / max(n1, 1.0) - (counts - ones) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(n1, 1.0) + 1 / n0))
    tells = np.flatnonzero((counts >= LEAST_TEXTS) & (z >= LEAST_Z))
    known = np.sort(found[tells[np.argsort(-z[tells], kind="stable")[:ROWS]]])
    model = TextConvolution(known)
    rows = model.rows(buckets)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    s = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            # Part of a text of label 0, or none of it, is of label 0 too.
            ends = [bounds[t] + (int(max(0.0, rng.random() - 0.5) * (bounds[t + 1] - bounds[t]) / 2) if labels[t] == 0 and rng.random() < CROPPED else bounds[t + 1] - bounds[t]) for t in some]
            some_rows = np.concatenate([rows[bounds[t] : end] for t, end in zip(some, ends, strict=True)])
            some_bounds = np.concatenate([[0], np.cumsum([end - bounds[t] for t, end in zip(some, ends, strict=True)])])
            g = model.gradients(some_rows, some_bounds, labels[some])
            step += 1
            for name in model.p:
                gradient = g[name] + DECAY * model.p[name]
                m[name] = 0.9 * m[name] + 0.1 * gradient
                s[name] = 0.999 * s[name] + 0.001 * np.square(gradient)
                model.p[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)
            model.p["E"][-1] = 0
    sampled = float(labels.mean()) if len(labels) else 0.5
    if 0 < sampled < 1 and 0 < share < 1:
        model.shift = float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return model


def thresholds(scored: DataFrame) -> DataFrame:
    """lang and cut, the bin from which flagging gives the best F1, of scored (lang, bin, y); the row of a null lang is
    that of all.  Languages of fewer than LEAST_ROWS rows, or of one label, have none."""
    counts = scored.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("hits"))
    rows = counts.where("lang is not null").union(counts.groupBy(F.lit(None).cast("string").alias("lang"), "bin").agg(F.sum("n"), F.sum("hits")))
    whole, above = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("bin"))
    rows = rows.select("lang", "bin", F.sum("n").over(above).alias("flagged"), F.sum("hits").over(above).alias("caught"), F.sum("n").over(whole).alias("n"), F.sum("hits").over(whole).alias("ones"))
    rows = rows.where((F.col("ones") > 0) & (F.col("ones") < F.col("n")) & (F.col("lang").isNull() | (F.col("n") >= LEAST_ROWS)))
    f1 = 2 * F.col("caught") / (F.col("flagged") + F.col("ones"))
    return rows.groupBy("lang").agg(F.max_by("bin", F.struct(f1, "bin")).alias("cut"))


def sample(docs: DataFrame, marked: DataFrame) -> pa.Table:
    """doc_id, text and y of the labelled rows that the fit may use, within SAMPLE and SAMPLE_BYTES: one text to a
    doc_id, taken in the order of the ids' hashes; texts that no longer fit are passed over."""
    wanted = None
    for y in (0, 1):
        some = marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
        wanted = some if wanted is None else wanted.union(some)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    found = keyed.drop("text").join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("size", "h")).alias("m"))
    left, chosen = SAMPLE_BYTES, []
    for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # 2 * SAMPLE rows at most
        if r.m["size"] <= left:
            left -= r.m["size"]
            chosen.append((r.doc_id, r.y, r.m["h"]))
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id bigint, y int, h bigint")
    return keyed.select("doc_id", "text", "h").join(F.broadcast(chosen), ["doc_id", "h"]).select("doc_id", "text", "y").dropDuplicates(["doc_id"]).toArrow()


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, and lang_threshold and flagged by the row's language.

    Null texts count as empty and are scored like others; a null or unknown language takes the threshold of all.  A
    doc_id's labels count once, as the smallest; rows that repeat a doc_id are scored each, and one of their texts may be
    fitted; rows with a null doc_id are scored and not held out; a score that equals a threshold is flagged.  Without
    labels of both kinds each score is the share of label 1 (0 without any).  Other columns, whatever their names, are
    left out.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1) & (fold_of("doc_id", 4) != 2)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    kept_out = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(KEPT_OUT)) == 0
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    docs = docs.select("doc_id", "text", lang.alias("lang"))
    table = sample(docs, marked.where(~kept_out))
    y = table.column("y").to_numpy().astype(np.float32)
    fitted = bool(len(y)) and 0 < y.sum() < len(y)
    if fitted:
        texts = table.column("text").combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        shared = spark.sparkContext.broadcast(train(texts, y, share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=500_000):
            if fitted:
                buckets, bounds = buckets_of(batch.column(1))
                scores = shared.value.score(shared.value.rows(buckets), bounds)
            else:
                scores = np.full(batch.num_rows, share)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(2)], names=["doc_id", "score", "lang"])

    scored = keep(docs.mapInArrow(run, "doc_id bigint, score double, lang string"), "toxicity")
    binned = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")
    cuts = keep(thresholds(scored.join(marked.where(kept_out), "doc_id").select("lang", binned, "y")), "thresholds")
    of_all = cuts.where("lang is null").first()
    default = of_all.cut / BINS if of_all else FLAG
    own = cuts.where("lang is not null").select("lang", (F.col("cut") / BINS).alias("own"))
    rows = scored.join(own, "lang", "left").withColumn("lang_threshold", F.coalesce("own", F.lit(default)))
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
