"""Threads: corroboration, lifecycle and resonance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lifecycles from the lowest, and the resonance from which a thread is resonant.
LIFECYCLES = ("LEAD", "CORROBORATED", "CONFIRMED")
RESONANT, LEAST_HOURS = 2.0, 0.5


def rank(lifecycle: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LIFECYCLES]), lifecycle).cast("int") - 1


def lifecycle(has_primary: Column, sources: Column, current: Column | None = None) -> Column:
    """What the members' tiers and the number of independent sources earn; never below ``current``."""
    earned = F.when(F.coalesce(has_primary, F.lit(False)), "CONFIRMED").when(F.coalesce(sources, F.lit(0)) >= 2, "CORROBORATED").otherwise("LEAD")
    return earned if current is None else F.when(rank(current) > rank(earned), current).otherwise(earned)


def resonance(sources: Column, hours: Column) -> Column:
    """Sources per hour, of half an hour at least; a single source doesn't resonate."""
    return F.when(sources <= 1, 0.0).otherwise(sources / F.greatest(hours, F.lit(LEAST_HOURS)))


def rollup(members: DataFrame) -> DataFrame:
    """A row for each thread of members (thread_id, publisher, tier, at)."""
    rolled = members.groupBy("thread_id").agg(
        F.count("*").alias("members"), F.countDistinct("publisher").alias("publishers"), F.bool_or(F.col("tier") == "primary").alias("p"),
        F.min("at").alias("first_seen"), F.max("at").alias("last_update"),
    )
    return rolled.select("thread_id", "members", "publishers", lifecycle(F.col("p"), F.col("publishers")).alias("lifecycle"), "first_seen", "last_update")


def material(before_rank: Column, rank_: Column, before: Column, sources: Column) -> Column:
    """Whether growth since the last summary is worth another: a higher lifecycle, or a quarter more sources."""
    previous = F.coalesce(before, F.lit(0))
    growth = sources - previous
    return F.when(rank_ > before_rank, True).otherwise((growth > 0) & ((previous <= 0) | (growth / previous >= 0.25)))


def worth_summary(primary: Column, account: Column, lifecycle_: Column, attention: Column, resonant: Column, publishers: Column) -> Column:
    """The first reason that earns a thread its summary, else 'none'."""
    rules = F.when(primary, "primary").when(account, "account").when(lifecycle_ == "CONFIRMED", "confirmed").when(attention, "attention")
    return rules.when(resonant, "resonant").when(publishers >= 3, "publishers").otherwise("none")
