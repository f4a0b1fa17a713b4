"""Connected components of links between long ids, by rounds of large and small stars.

Each round is two aggregations with map-side minima and two joins on the node.  The joins carry no salt: a hub's edges
meet in one task of a round unless Spark splits that partition (its skew join does where a partition is large enough).
The edges of every round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm.store import drop, keep


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(xxhash64(a, b) >> 24)")).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the component is its smallest node.  No links: no rows."""
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(edges)
    while before[0]:
        # Large star: every larger neighbour of a node takes the smallest in the node's neighbourhood.
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = keep(large, "edges")
        # Small star: the smaller neighbours of a node, and the node, take the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        after_edges = keep(small.where("a <> b").distinct(), "edges")
        after = _state(after_edges)
        drop(large)
        drop(edges)
        edges = after_edges
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
