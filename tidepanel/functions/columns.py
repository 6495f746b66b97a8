"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_ticker() -> WindowSpec:
    """Across time."""
    return W.partitionBy("ticker").orderBy("t")


def rows(first: int | None, last: int) -> WindowSpec:
    """A ticker's rows from ``first`` (None: the first of all) to ``last``, counted from the current one."""
    return by_ticker().rowsBetween(W.unboundedPreceding if first is None else first, last)


def ratio(x: Column, y: Column) -> Column:
    """``x / y``, null where y is 0."""
    return x / F.when(y != 0, y)


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(rows(None, 0))


def compounded(ret: Column, first: int, last: int) -> Column:
    """Product of 1 + return over a frame, minus 1. Missing returns are skipped, so it is never null."""
    return F.coalesce(F.product(1 + ret).over(rows(first, last)), F.lit(1.0)) - 1


def clipped(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` within bounds; null stays null (``least`` and ``greatest`` alone would skip it)."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def dot(a: Column, b: Column) -> Column:
    """The sum of products of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
