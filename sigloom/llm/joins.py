"""Joins on keys of which a few may hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows on, or from this share of all of them if that is more: no more than MOST_HOT keys
#: can be hot, whatever the input, so they may be sent to all tasks.
HOT, MOST_HOT = 1_000, 50_000


def hot_from(total: int) -> int:
    """Rows from which a key is hot, where ``total`` is the number of rows of all keys."""
    return max(HOT, -(-total // MOST_HOT))


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """The inner join of ``rows`` with ``table``, which has each key once with the number of its rows in ``size``.

    Rows of hot keys stay where they are and meet the table's few hot rows there; the others are dealt by key."""
    hot = F.col(size) >= hot_from(total)
    few = F.broadcast(table.where(hot))
    rest = rows.join(F.broadcast(table.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(table.where(~hot), keys))
