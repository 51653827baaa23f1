"""Rolling windows over ordered rows, and over calendar days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import col


def frame(n: int, align: str = "right") -> tuple[int, int]:
    """First and last row, relative to the current, of a window of n rows."""
    if align == "right":
        return 1 - n, 0
    if align == "left":
        return 0, n - 1
    if align == "center":
        return -(n - 1) // 2 if n % 2 else 1 - n // 2, n // 2
    raise ValueError(f"no alignment {align!r}")


def roll(x: Column | str, how: Callable[[Column], Column], n: int, over: WindowSpec, align: str = "right", fill=None, full: bool = True) -> Column:
    """``how`` over n rows; where fewer than n exist, ``fill`` (missing unless given), or the partial result if not ``full``.

    Missing values within a window are left out by the aggregate.
    """
    low, high = frame(n, align)
    value = how(col(x)).over(over.rowsBetween(low, high))
    if not full:
        return value
    rows = F.count(F.lit(1)).over(over.rowsBetween(low, high))
    return F.when(rows == n, value).otherwise(F.lit(fill))


def range_roll(x: Column | str, how: Callable[[Column], Column], low: int, high: int, keys: list[str], by: str) -> Column:
    """``how`` over the rows whose ``by`` differs from this row's by low..high (calendar offsets on irregular days)."""
    return how(col(x)).over(Window.partitionBy(*keys).orderBy(by).rangeBetween(low, high))


def isolated(x: Column | str, n: int, over: WindowSpec) -> Column:
    """1 where x is 1 and the only 1 of the last n rows; 0 otherwise."""
    return F.when((col(x) == 1) & (F.sum(col(x)).over(over.rowsBetween(1 - n, 0)) == 1), 1).otherwise(0)


def hold(x: Column | str, n: int, over: WindowSpec) -> Column:
    """A box filter capped at 1: whether x was positive in the last n rows."""
    return F.max((col(x) > 0).cast("int")).over(over.rowsBetween(1 - n, 0))


def halved(x: Column | str, event: Column, over: WindowSpec) -> Column:
    """x divided by 2 for each event so far."""
    return col(x) / F.pow(F.lit(2.0), F.sum(event.cast("int")).over(over.rowsBetween(Window.unboundedPreceding, 0)))
