"""Running sums and maxima over arrays, in expressions.

A fold that gathers an array copies it at each step, so it is quadratic in what it gathers.  Here folds hold one number
only: each element's value is a fold over its own block up to it, blocks are put on top of what comes before them in the
same way, and so on for blocks of blocks.  An element costs about WIDE / 2 additions whatever the array's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block, and levels of blocks; the last level's folds go over all before them.
WIDE, LEVELS = 64, 2

Combine = Callable[[Column, Column], Column]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value found once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, combine: Combine, zero: Column, levels: int) -> Column:
    each = lambda block: F.transform(block, lambda _, i: F.aggregate(F.slice(block, 1, i + 1), zero, combine))
    if not levels:
        return each(values)

    def onto(inner: Column) -> Column:
        totals = F.transform(inner, lambda block: F.get(block, F.size(block) - 1))
        before = lambda done: F.transform(inner, lambda block, k: F.transform(block, lambda v: F.when(k > 0, combine(F.get(done, k - 1), v)).otherwise(v)))
        return F.flatten(let(_running(totals, combine, zero, levels - 1), before))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / WIDE).cast("int")), lambda k: F.slice(values, k * WIDE + 1, WIDE))
    return F.when(F.size(values) > 0, let(F.transform(blocks, each), onto)).otherwise(values)


def running_sum(values: Column) -> Column:
    """The sum of each element (bigint) and those before it."""
    return let(values, lambda v: _running(v, lambda a, b: a + b, F.lit(0).cast("bigint"), LEVELS))


def running_max(values: Column) -> Column:
    """The largest of each element (bigint) and those before it."""
    return let(values, lambda v: _running(v, lambda a, b: F.greatest(a, b), F.lit(-(1 << 62)).cast("bigint"), LEVELS))
