"""Column expressions with the missing-value rules of a statistics language.

Missing in, missing out, unless a name says otherwise; halves round to even.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def if_else(condition: Column, yes, no) -> Column:
    """A missing condition gives a missing value (``CASE`` alone would take the last branch)."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def clamp(x: Column | str, low: float, high: float) -> Column:
    """Into [low, high]; ``greatest`` and ``least`` alone would turn a missing value into a bound."""
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def parallel_max(x: Column | str, low: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def rescale(x: Column | str, low: Column, high: Column) -> Column:
    """Linear to [0, 1]; 0 where low and high meet."""
    return F.coalesce(F.try_divide(col(x) - low, high - low), F.lit(0.0))


def ratio(x: Column | str, y: Column | str) -> Column:
    """x / y of doubles by the rules of floating-point numbers: where y is 0, infinite or not a number, and no error."""
    return F.when(col(y) == 0, col(x) * F.lit(float("inf"))).otherwise(col(x) / col(y))


def sigmoid(x: Column | str, steepness: float = 1.0, middle: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-steepness * (col(x) - middle)))


def to_step(x: Column | str, step: float) -> Column:
    """To the nearest multiple of ``step``, halves to even."""
    return F.bround(col(x) / step) * step


def cut(x: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed bin (breaks[k], breaks[k+1]]; missing outside."""
    if len(breaks) != len(labels) + 1:
        raise ValueError("one label for each bin is needed")
    x, out = col(x), F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(breaks, breaks[1:], labels):
        out = out.when((x > low) & (x <= high), label)
    return out


def midpoints(levels: Sequence[float]) -> list[float]:
    """Breaks halfway between levels, open at both ends."""
    return [float("-inf"), *((a + b) / 2 for a, b in zip(levels, levels[1:])), float("inf")]


def lookup(x: Column | str, table: Mapping, default=None) -> Column:
    """Value of a small fixed dictionary."""
    x, out = col(x), None
    for key, value in table.items():
        out = F.when(x == key, F.lit(value)) if out is None else out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(default))


def by_position(code: Column | str, labels: Sequence[str], first: int = 1) -> Column:
    """Label number code of a list; missing outside it."""
    return F.get(F.array(*[F.lit(x) for x in labels]), (col(code) - first).cast("int"))


def level(x: Column | str, levels: Sequence[str]) -> Column:
    """1-based place of a value in an ordered list of levels; missing outside it."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), col(x)), F.lit(0))


def sentence(x: Column | str) -> Column:
    """First letter upper case, the rest lower."""
    x = col(x)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.char_length(x))))


def weighted_mean(x: Column | str, weight: Column | str) -> Column:
    """Aggregate: missing values drop out with their weights."""
    x, weight = col(x), col(weight)
    return F.try_divide(F.sum(x * weight), F.sum(F.when(x.isNotNull(), weight)))


def strict(aggregate: Column, x: Column | str) -> Column:
    """An aggregate that is missing as soon as one value is."""
    return F.when(F.count(F.lit(1)) == F.count(col(x)), aggregate)


def distinct_with_missing(x: Column | str) -> Column:
    """Aggregate: number of distinct values, a missing one counting as a value."""
    x = col(x)
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))
