"""Quantiles that merge: a column of sketches by key, which add up over time, keys and files, and are read out at the end.

A sketch (Karnin, Lang and Liberty, 2016) is a binary value of some kilobytes, however many values it has seen. An exact
percentile has to bring a group's values together; sketches are made where the rows are, and only they are exchanged. They
can be stored and merged again later, say daily ones to weekly ones. What is stated is the error in *rank*: a value that is
read out for the quantile p is the exact quantile of some p' with abs(p - p') within the error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col

#: Published fit of the error in rank that holds with 99 %, by the size k: A / k ** B.
A, B = 2.296, 0.9723
SIZES = (8, 65535)


def size_for(error: float) -> int:
    """Size of a sketch for an error in rank: twice that which keeps within it with 99 %, so that it holds at some five deviations."""
    if not 0 < error < 1:
        raise ValueError("an error in rank is between 0 and 1")
    k = 2 * round((A / error) ** (1 / B))
    if k > SIZES[1]:
        raise ValueError(f"no sketch is as exact as {error}")
    return max(SIZES[0], k)


def sketch(x: Column | str, error: float = 0.01) -> Column:
    """Aggregate: a sketch of the values that are not missing, or missing if there are none."""
    value = col(x).cast("double")
    return F.when(F.count(value) > 0, F.kll_sketch_agg_double(value, size_for(error)))


def merged(sketches: Column | str) -> Column:
    """Aggregate: one sketch of all that the sketches have seen; they should be of one size."""
    return F.when(F.count(col(sketches)) > 0, F.kll_merge_agg_double(col(sketches)))


def quantiles(sketches: Column | str, ps: list[float]) -> Column:
    """Values of these quantiles, in their order; missing for a missing sketch."""
    return F.kll_sketch_get_quantile_double(col(sketches), F.array(*[F.lit(float(p)) for p in ps]))


def seen(sketches: Column | str) -> Column:
    """How many values a sketch has seen; exact."""
    return F.coalesce(F.kll_sketch_get_n_double(col(sketches)), F.lit(0).cast("long"))


def sketch_table(df: DataFrame, keys: list[str], columns: list[str], error: float = 0.01) -> DataFrame:
    """One sketch for each key and column: keys, channel, sketch."""
    wide = df.groupBy(*keys).agg(*[sketch(c, error).alias(c) for c in columns])
    return wide.unpivot(keys, columns, "channel", "sketch")


def coarser(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of ``sketch_table`` merged to fewer keys."""
    return sketches.groupBy(*keys, "channel").agg(merged("sketch").alias("sketch"))


def read_out(sketches: DataFrame, ps: list[float]) -> DataFrame:
    """A row for each sketch and quantile: its keys, channel, n, p, value."""
    values = F.posexplode_outer(quantiles("sketch", ps)).alias("__place", "value")
    rows = sketches.withColumn("n", seen("sketch")).select(*[c for c in sketches.columns if c != "sketch"], "n", values)
    return rows.withColumn("p", F.element_at(F.array(*[F.lit(float(p)) for p in ps]), F.col("__place") + 1)).filter("n > 0").drop("__place")


def rank_errors(df: DataFrame, found: DataFrame, keys: list[str], column: str) -> DataFrame:
    """How far in rank the values of ``read_out`` are from the exact quantiles: keys, p, error (0 within a run of ties)."""
    x = F.col(column)
    known = df.filter(x.isNotNull()).select(*keys, x.alias("__x"))
    counted = known.join(found.select(*keys, "p", "value", "n"), keys).groupBy(*keys, "p").agg(F.sum((F.col("__x") < F.col("value")).cast("long")).alias("under"), F.sum((F.col("__x") <= F.col("value")).cast("long")).alias("upto"), F.first("n").alias("n"))
    return counted.select(*keys, "p", F.greatest(F.col("under") / F.col("n") - F.col("p"), F.col("p") - F.col("upto") / F.col("n"), F.lit(0.0)).alias("error"))
