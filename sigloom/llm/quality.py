"""Quality classifier: regularised quadratic discriminant over transformed statistics of whole texts.

Each class is a Gaussian whose covariance is shrunk towards the pooled one and towards a multiple of the identity.  A
score is the logistic of the difference of the Mahalanobis log-densities, from Cholesky factors made once.  The sums
that the fit needs are added up in Spark over every labelled row outside the held-out fold; no row is sampled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.store import keep
from sigloom.llm.textbatch import SMALL, chunks, flat, lower, mix, word_bounds, word_hashes

#: Weights of the pooled covariance and of the identity in each class's covariance.
TO_POOLED, TO_IDENTITY = 0.05, 0.02
#: Scores below this are label 0.
ACCEPT = 0.7
FEATURES = ("log_bytes", "log_words", "word_length", "letters", "upper", "digits", "marks", "odd_marks", "spaces", "distinct", "top_word", "distinct_lines", "line_length", "marked_words", "other_bytes")

_IS = {name: np.zeros(256, bool) for name in ("letter", "upper", "digit", "mark", "odd", "line")}
_IS["letter"][[*range(65, 91), *range(97, 123)]] = True
_IS["letter"][128:] = True
_IS["upper"][65:91] = True
_IS["digit"][48:58] = True
_IS["mark"][[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_IS["odd"][[ord(c) for c in "#$%&*!|<>{}[]\\^~_=+@"]] = True
_IS["line"][10] = True


def _per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values and of the commonest one, for each document (1 and 0 where there are none)."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = np.diff(bounds).astype(float)
    if not len(hashes):
        return np.ones(len(n)), np.zeros(len(n))
    key = mix(hashes + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(key[order][1:] != key[order][:-1]) + 1])
    counts = np.diff(np.concatenate([first, [len(key)]]))
    owner = doc[order][first]
    top = np.zeros(len(n))
    np.maximum.at(top, owner, counts)
    some = np.maximum(n, 1)
    return np.where(n > 0, np.bincount(owner, minlength=len(n)) / some, 1.0), top / some


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; null is empty."""
    data, offsets = flat(column)
    n_bytes = np.diff(offsets).astype(float)
    some = np.maximum(n_bytes, 1)
    first, last, bounds = word_bounds(data, offsets)
    hashes = word_hashes(lower(data), first, last)
    n_words = np.diff(bounds).astype(float)
    words = np.maximum(n_words, 1)
    share = {name: np.sqrt(_per_doc(table[data], offsets) / some) for name, table in _IS.items()}
    spaces = n_bytes - _per_doc(_inside(len(data), first, last), offsets)
    distinct, top = _distinct(hashes, bounds)
    ends_marked = np.concatenate([[0], np.cumsum(_IS["odd"][data[last - 1]], dtype=np.int64)]) if len(last) else np.zeros(1, np.int64)
    marked = (ends_marked[bounds[1:]] - ends_marked[bounds[:-1]]) / words
    # Lines: stretches between line ends, by the fingerprint of their bytes.
    begins = np.unique(np.concatenate([offsets[:-1][n_bytes > 0], np.flatnonzero(_IS["line"][data]) + 1]))
    begins = begins[begins < len(data)]
    line_bounds = np.searchsorted(begins, offsets)
    line_ends = np.concatenate([begins[1:], [len(data)]]) if len(begins) else begins
    lines = np.maximum(np.diff(line_bounds), 1)
    distinct_lines, _ = _distinct(word_hashes(data, begins, line_ends), line_bounds)
    return np.stack(
        [np.log1p(n_bytes), np.log1p(n_words), np.log1p(n_bytes / words), share["letter"], share["upper"], share["digit"], share["mark"], share["odd"], np.sqrt(np.maximum(spaces, 0) / some),
         distinct, np.sqrt(top), distinct_lines, np.log1p(n_bytes / lines), np.sqrt(marked), np.sqrt(_per_doc(data >= 128, offsets) / some)],
        axis=1,
    )


def _inside(n: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int8)
    step[first] += 1
    step[last] -= 1
    return np.cumsum(step[:-1])


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id and the features of every row, kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=SMALL):
            rows = features(batch.column(1))
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, len(FEATURES), dtype=np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])

    return keep(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>"), "features")


class Discriminant:
    """Two Gaussians: log-densities by cached Cholesky factors."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, squares: np.ndarray):
        """Count, sum and sum of outer products of each class."""
        d = sums.shape[1]
        self.fitted = bool((n > 1).all())
        self.prior = float(n[1] / n.sum()) if n.sum() else 0.5
        if not self.fitted:
            return
        self.means = sums / n[:, None]
        covariances = squares / n[:, None, None] - self.means[:, :, None] * self.means[:, None, :]
        pooled = (covariances * n[:, None, None]).sum(axis=0) / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
        scaled = covariances / np.outer(self.scale, self.scale)
        pooled = pooled / np.outer(self.scale, self.scale)
        shrunk = (1 - TO_POOLED - TO_IDENTITY) * scaled + TO_POOLED * pooled + TO_IDENTITY * np.eye(d)
        self.factors = [np.linalg.inv(np.linalg.cholesky(s + 1e-9 * np.eye(d))) for s in shrunk]
        self.log_dets = [2 * float(np.log(np.diag(f)).sum()) for f in self.factors]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1."""
        if not self.fitted:
            return np.full(len(x), self.prior)
        logs = []
        for k in (0, 1):
            z = ((x - self.means[k]) / self.scale) @ self.factors[k].T
            logs.append(0.5 * self.log_dets[k] - 0.5 * np.square(z).sum(axis=1))
        margin = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def fit(table: DataFrame, labels: DataFrame, label: str) -> Discriminant:
    """From every row of the feature table with a label outside the held-out fold.  A doc_id's labels count once."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    rows = table.where(fold_of("doc_id", 4) != 2).join(marked, "doc_id").select("y", "x")
    d = len(FEATURES) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.concatenate([np.ones((len(y), 1)), batch.column(1).flatten().to_numpy().reshape(len(y), d - 1)], axis=1)
            for k in (0, 1):
                total[k] += x[y == k].T @ x[y == k]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "v"])

    cells = rows.mapInArrow(sums, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(2 * d * d)
    for cell, value in cells:
        total[cell] = value
    total = total.reshape(2, d, d)
    return Discriminant(total[:, 0, 0], total[:, 0, 1:], total[:, 1:, 1:])


def score(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null texts count as empty and are scored like others.  Without labels of both kinds each score is the share of
    label 1 (0.5 without any).  Rows with a null doc_id are scored and not held out.  An empty table gives no rows.
    """
    table = feature_table(docs)
    model = fit(table, labels, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores all ``documents``."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
