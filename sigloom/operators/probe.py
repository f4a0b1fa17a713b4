"""A linear probe for each target: logistic regression by plain gradient steps, and its use on all rows.

A target of few labels is one task's work.  The labels of larger ones are spread as blocks over all tasks: a step is a
pass over these that sends back sums as long as the weights, of all targets and folds at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.operators.ranking import rank_sum_auc, running_by_range
from sigloom.sources.folders import ready_checkpoints

#: Labels up to which a target is one task's work; labels of a block of larger ones.
ALONE, BLOCK = 20_000, 4096
#: Fixed values of the fit.
STEPS, RATE, DECAY, FOLDS, LEAST_EACH = 300, 0.5, 1.0, 5, 20
#: Precision from which a probe adds, and the least score that may; recall that a veto keeps, and the
#: highest score that it may have; positives that a precision needs.
ADD_PRECISION, ADD_FLOOR, VETO_RECALL, VETO_CEIL, LEAST_FOUND = 0.90, 0.80, 0.97, 0.20, 5


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias after STEPS full steps; the weights decay, the bias doesn't."""
    w, b, n = np.zeros(x.shape[1]), 0.0, len(y)
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= RATE * (x.T @ error / n + DECAY * w / n)
        b -= RATE * error.mean()
    return w, b


def area(scores: np.ndarray, y: np.ndarray) -> float:
    """The chance that a positive scores above a negative, ties half."""
    ranks = pd.Series(scores).rank().to_numpy()
    positive = int(y.sum())
    return float((ranks[y == 1].sum() - positive * (positive + 1) / 2) / (positive * (len(y) - positive)))


def thresholds(p: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The score from which a probe adds, the last down to which precision holds, and that up to which it vetoes; equal
    scores count together."""
    order = np.argsort(-p, kind="stable")
    s, found = p[order], np.cumsum(y[order])
    whole = np.append(s[1:] != s[:-1], True)
    good = s[whole & (found >= ADD_PRECISION * np.arange(1, len(s) + 1)) & (found >= LEAST_FOUND)]
    positive = np.sort(p[y == 1])
    veto = positive[max(0, int((1 - VETO_RECALL) * len(positive)) - 1)] if len(positive) else 0.0
    return min(max(good[-1] if len(good) else 1.01, ADD_FLOOR), 0.99), max(min(veto, VETO_CEIL), 0.0)


MODEL = "target bigint, n bigint, auc double, enabled boolean, weights array<double>, bias double, add_t double, veto_t double"


def train_targets(rows: DataFrame) -> DataFrame:
    """rows (target, id, y, x array<double>) -> target, n, auc by folds of the id's hash, enabled, weights, bias and the
    thresholds by the folds' scores.  Targets with more than ALONE labels are fitted by all tasks together."""
    folded = rows.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int"))
    large = [r.target for r in rows.groupBy("target").count().where(F.col("count") > ALONE).collect()]  # as few as targets are trained
    if not large:
        return _train_alone(folded)
    return _train_alone(folded.where(~F.col("target").isin(large))).union(_train_spread(folded.where(F.col("target").isin(large))))


def _train_alone(folded: DataFrame) -> DataFrame:
    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        x, y, fold = np.stack(part["x"].to_numpy()), part["y"].to_numpy(float), part["fold"].to_numpy()
        scores, enough = np.zeros(len(y)), min(y.sum(), len(y) - y.sum()) >= LEAST_EACH
        auc = float("nan")
        if enough:
            for k in range(FOLDS):
                w, b = fit(x[fold != k], y[fold != k])
                scores[fold == k] = x[fold == k] @ w + b
            auc = area(scores, y)
        w, b = fit(x, y)
        add, veto = thresholds(1 / (1 + np.exp(-scores)), y) if enough else (0.99, 0.0)
        return pd.DataFrame({"target": [key[0]], "n": [len(y)], "auc": [auc], "enabled": [bool(enough and auc >= 0.9)], "weights": [w.tolist()], "bias": [b], "add_t": [add], "veto_t": [veto]})

    return folded.groupBy("target").applyInPandas(one, MODEL)


def _train_spread(folded: DataFrame) -> DataFrame:
    """The same fits, each step a sum over blocks of labels; scores are ranked by range."""
    spark = folded.sparkSession
    ready_checkpoints(spark)
    totals: dict[int, np.ndarray] = {}  # labels and positives of each fold
    for r in folded.groupBy("target", "fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect():
        totals.setdefault(r.target, np.zeros((FOLDS, 2)))[r.fold] = r.n, r.pos
    parts = -(-int(max(t[:, 0].sum() for t in totals.values())) // BLOCK)

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(part["x"].to_numpy()).astype(np.float64)
        return pd.DataFrame({"target": [key[0]], "y": [part["y"].to_numpy(np.float64).tobytes()], "fold": [part["fold"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "size": [x.shape[1]]})

    dealt = folded.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(parts)))
    blocks = dealt.groupBy("target", "part").applyInPandas(pack, "target bigint, y binary, fold binary, x binary, size int").checkpoint().persist()
    size = blocks.agg(F.max("size")).first()[0]
    # A column of weights, the bias last, for each fold that is left out and for none.
    fitted = {t: np.zeros((size + 1, FOLDS + 1)) for t in totals}
    counts = {t: np.append(c[:, 0].sum() - c[:, 0], c[:, 0].sum()) for t, c in totals.items()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for k in range(batch.num_rows):
                buffer = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: E731, B023
                y = buffer("y", np.float64)
                yield batch.column("target")[k].as_py(), y, buffer("fold", np.int64), buffer("x", np.float64).reshape(len(y), -1)

    def slopes(now: dict[int, np.ndarray]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for target, y, fold, x in read(batches):
                w = now[target]
                error = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y[:, None]
                error[np.arange(len(y)), fold] = 0  # rows of the fold that is left out
                sums[target] = sums.get(target, 0) + np.vstack([x.T @ error, error.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["target", "sums"])

        return blocks.mapInArrow(run, "target bigint, sums binary")

    for _ in range(STEPS):
        slope = {t: np.zeros_like(w) for t, w in fitted.items()}
        for r in slopes(fitted).collect():  # as long as the weights, from each task
            slope[r.target] += np.frombuffer(r.sums, np.float64).reshape(size + 1, -1)
        for t, w in fitted.items():
            n = np.maximum(counts[t], 1)
            w[:-1] -= RATE * (slope[t][:-1] / n + DECAY * w[:-1] / n)
            w[-1] -= RATE * slope[t][-1] / n

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for target, y, fold, x in read(batches):
            w = fitted[target]
            s = (x @ w[:-1] + w[-1])[np.arange(len(y)), fold]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), target)), pa.array(y), pa.array(s)], names=["target", "y", "score"])

    scores = blocks.mapInArrow(scored, "target bigint, y double, score double").checkpoint()
    found = []
    for t, c in totals.items():
        n, pos = int(c[:, 0].sum()), int(c[:, 1].sum())
        enough, auc, cuts = min(pos, n - pos) >= LEAST_EACH, float("nan"), (0.99, 0.0)
        if enough:
            mine = scores.where(F.col("target") == t).select("y", "score")
            auc, cuts = rank_sum_auc(mine).first().auc, _thresholds_by_range(mine.select("y", (1 / (1 + F.exp(-F.col("score")))).alias("p")), n, pos)
        found.append((t, n, auc, bool(enough and auc >= 0.9), fitted[t][:-1, -1].tolist(), float(fitted[t][-1, -1]), *cuts))
    blocks.unpersist()
    return spark.createDataFrame(found, MODEL)


def _thresholds_by_range(rows: DataFrame, n: int, positives: int) -> tuple[float, float]:
    """``thresholds`` of rows (y, p), n of them, by running sums over ranges of p."""
    counts = rows.groupBy("p").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    found, above = positives - F.col("before_pos"), n - F.col("before_n")  # from this score up
    good = (found >= ADD_PRECISION * above) & (found >= LEAST_FOUND)
    at = max(0, int((1 - VETO_RECALL) * positives) - 1)
    vetoed = (F.col("before_pos") <= at) & (F.col("before_pos") + F.col("pos") > at)
    cut = running_by_range(counts, "p", "n", "pos").agg(F.min(F.when(good, F.col("p"))).alias("add"), F.min(F.when(vetoed, F.col("p"))).alias("veto")).first()
    return min(max(1.01 if cut.add is None else cut.add, ADD_FLOOR), 0.99), max(min(cut.veto, VETO_CEIL), 0.0)


def apply_probe(rows: DataFrame, models: DataFrame) -> DataFrame:
    """id, target, p of every row under every enabled model; models are as few as targets are trained."""
    enabled = {r.target: (np.array(r.weights), r.bias) for r in models.where("enabled").toLocalIterator()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for target, (w, b) in enabled.items():
                p = 1 / (1 + np.exp(-(x @ w + b)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(p), target)), pa.array(p)], names=["id", "target", "p"])

    return rows.select("id", "x").mapInArrow(run, "id bigint, target bigint, p double")


def changes(scores: DataFrame, probes: DataFrame, relations: DataFrame) -> DataFrame:
    """What probes (target, add_t, veto_t) change by scores (thread_id, target, p) among relations (thread_id, target,
    source, verdict): relations that they add, those that they veto before any verdict, and new scores."""
    probes = F.broadcast(probes)  # a row for each target with a probe
    rows = scores.join(probes, "target").join(relations, ["thread_id", "target"], "left")
    new = F.col("source").isNull()
    vetoed = F.col("verdict").isNull() & F.col("source").isin("match", "route") & (F.col("p") <= F.col("veto_t"))
    rows = rows.withColumn("change", F.when(new & (F.col("p") >= F.col("add_t")), "added").when(~new, F.when(vetoed, "vetoed").otherwise("scored"))).where("change is not null")
    final = F.when(F.col("change") == "vetoed", False).otherwise(F.col("verdict"))
    return rows.select("thread_id", F.col("target").cast("bigint").alias("target"), "change", F.col("p").alias("score"), F.coalesce("source", F.lit("model")).alias("source"), final.alias("verdict"))
