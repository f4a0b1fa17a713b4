"""The register of queries: each is a function (spark, sf_dir) -> DataFrame, most beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are sent to all tasks; more of them are joined by a shuffle.
SENT = 100_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sent(rows: DataFrame, most: int = SENT) -> DataFrame:
    """``rows`` marked for all tasks, if they are few by count."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
