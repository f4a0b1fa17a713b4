"""Ranks over all rows without one task that holds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_by_range(counts: DataFrame, order: str, *sums: str) -> DataFrame:
    """``counts`` with ``before_<sum>``: each sum over the rows of lower ``order``, whose values are distinct.

    Rows go to ranges of ``order``; sums run inside a range and start from those of the ranges below, which are as few
    as there are tasks.
    """
    parted = counts.repartitionByRange(order).withColumn("part", F.spark_partition_id())
    totals = parted.groupBy("part").agg(*[F.sum(s).alias(f"t_{s}") for s in sums])
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", *[F.coalesce(F.sum(f"t_{s}").over(below), F.lit(0)).alias(f"b_{s}") for s in sums])
    inside = Window.partitionBy("part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = parted.join(F.broadcast(bases), "part")  # a row for each task
    return joined.select(*counts.columns, *[(F.col(f"b_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))).alias(f"before_{s}") for s in sums])


def rank_sum_auc(rows: DataFrame) -> DataFrame:
    """auc of rows (y, score) in one row."""
    counts = rows.groupBy("score").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"))
    ranked = running_by_range(counts, "score", "n")
    mid = F.col("before_n") + (F.col("n") + 1) / 2
    totals = ranked.agg(F.sum(mid * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return totals.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))
