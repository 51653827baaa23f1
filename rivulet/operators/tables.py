"""Relational operators beyond the DataFrame verbs: folds, shares, level axes, reshaping."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def full_join_all(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full join of several frames on the same keys; other columns get the frame's name as a suffix."""
    renamed = [df.withColumnsRenamed({c: f"{c}_{name}" for c in df.columns if c not in keys}) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, keys, "full"), renamed)


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column that one lacks is missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def share_within(df: DataFrame, keys: list[str], within: list[str], weight: str | None = None, name: str = "share") -> DataFrame:
    """Rows (or sum of weights) by ``keys``, and its share of the total by ``within``."""
    counted = df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    return counted.withColumn(name, F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def all_levels(df: DataFrame, axes: dict[str, list], value: str, zero=0) -> DataFrame:
    """A frequency table with its empty cells; the axes are short fixed lists."""
    cells = product(*axes.values())
    schema = ", ".join(f"`{name}` {df.schema[name].dataType.simpleString()}" for name in axes)
    grid = df.sparkSession.createDataFrame(list(cells), schema)
    # the cells are rows of the table that lose to its own: a union and one aggregate, without a join
    both = df.withColumn("__own", F.lit(1)).unionByName(grid.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    others = [c for c in df.columns if c not in axes]
    inside = reduce(lambda a, b: a & b, [F.col(name).isin(levels) for name, levels in axes.items()])
    own = both.filter(inside).groupBy(*axes).agg(F.max_by(F.struct(*others), "__own").alias("__row"))
    return own.select(*axes, *[F.col("__row")[c].alias(c) for c in others]).withColumn(value, F.coalesce(value, F.lit(zero)))


def longer(df: DataFrame, ids: list[str], values: list[str], name: str = "name", value: str = "value", prefix: str = "") -> DataFrame:
    """One row for each of the value columns; ``prefix`` is cut from their names."""
    long = df.unpivot(ids, values, name, value)
    return long.withColumn(name, F.expr(f"substring({name}, {len(prefix) + 1})")) if prefix else long


def longer_by_parts(df: DataFrame, ids: list[str], values: list[str], sep: str = "_", name: str = "name") -> DataFrame:
    """Columns named value<sep>key become rows by key, with one column for each value name."""
    found: dict[str, dict[str, str]] = {}
    for c in values:
        left, _, right = c.partition(sep)
        found.setdefault(right, {})[left] = c
    heads = list(dict.fromkeys(c.partition(sep)[0] for c in values))
    rows = [F.struct(F.lit(k).alias(name), *[(F.col(v[h]) if h in v else F.lit(None)).alias(h) for h in heads]) for k, v in found.items()]
    return df.select(*ids, F.explode(F.array(*rows)).alias("__r")).select(*ids, "__r.*")


def wider(df: DataFrame, ids: list[str], name: str, levels: list, value: str, prefix: str = "", how=F.first) -> DataFrame:
    """One column for each of the given levels."""
    got = df.groupBy(*ids).pivot(name, levels).agg(how(value))
    return got.withColumnsRenamed({str(x): f"{prefix}{x}" for x in levels})


def dominant(df: DataFrame, keys: list[str], value: str, factor: float = 5.0) -> DataFrame:
    """By key: the most frequent value, if it is the only one or over ``factor`` times as frequent as the next, as ``odd``."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(value))
    ranked = counted.withColumn("place", F.row_number().over(by)).withColumn("next", F.lead("n").over(by)).filter("place = 1")
    return ranked.select(*keys, F.when(F.col("next").isNull() | (F.col("n") > factor * F.col("next")), F.col(value)).alias("odd"))


def with_dominant(df: DataFrame, key: str, value: str, factor: float = 5.0) -> DataFrame:
    """Adds ``odd`` (see ``dominant``) to every row, by windows on one dealing of the rows by key."""
    n = F.count(value).over(Window.partitionBy(key, value))
    by = Window.partitionBy(key).orderBy(F.desc("__n"), F.col(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = df.withColumn("__n", F.when(F.col(value).isNotNull(), n)).withColumn("__top", F.first(value).over(by))
    whole = Window.partitionBy(key)
    most = lambda own: F.max(F.when((F.col(value) == F.col("__top")) == own, F.col("__n"))).over(whole)
    ranked = counted.withColumns({"__most": most(F.lit(True)), "__next": most(F.lit(False))})
    odd = F.when(F.col("__next").isNull() | (F.col("__most") > factor * F.col("__next")), F.col("__top"))
    return ranked.withColumn("odd", odd).drop("__n", "__top", "__most", "__next")


def ranked(df: DataFrame, order: list[str], name: str = "rank", cells: int = 64) -> DataFrame:
    """Adds the number of each row (from 1) in an order that begins with a number column.

    Rows are dealt to cells of about equal size by quantiles of that column and numbered in each; only the sizes of the
    cells are added up in one place. Missing values come first.
    """
    bounds = sorted(set(df.approxQuantile(order[0], [k / cells for k in range(1, cells)], 0.001)))
    below = F.filter(F.lit(bounds).cast("array<double>"), lambda b: b < F.col(order[0])) if bounds else F.array()
    dealt = df.withColumn("__cell", F.when(F.col(order[0]).isNull(), -1).otherwise(F.size(below)))
    sizes = dealt.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(*order))
    offsets = F.broadcast(sizes.select("__cell", before.alias("__before")))  # a row for each cell
    return dealt.withColumn("__inside", inside).join(offsets, "__cell").withColumn(name, F.col("__before") + F.col("__inside")).drop("__cell", "__before", "__inside")


def bind_columns(a: DataFrame, b: DataFrame, order_a: list[str], order_b: list[str]) -> DataFrame:
    """Columns of both side by side, row by row in their orders; the longer one's last rows have missing values beside them."""
    return ranked(a, order_a).join(ranked(b, order_b), "rank", "full")
