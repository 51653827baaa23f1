"""Operators on panels of sequences: rows keyed by a sequence and ordered by day.

Every function takes and returns a DataFrame. All windows partition by the
sequence, so a panel that is once dealt by it needs no further shuffle, and
runs are found by cumulative sums, never by self-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import col


def ordered(*keys: str, by: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def up_to(*keys: str, by: str = "t") -> WindowSpec:
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def relative_day(df: DataFrame, seq: str = "seq_id", date: str = "d", name: str = "t") -> DataFrame:
    """Day number within the sequence, from 1."""
    return df.withColumn(name, F.datediff(date, F.min(date).over(Window.partitionBy(seq))) + 1)


def densify(df: DataFrame, seq: str = "seq_id", date: str = "d") -> DataFrame:
    """One row for each day from a sequence's first to its last; new rows have missing values.

    Of several rows of one day the one that sorts first by all its columns stays; a row without a day is left out. Each
    row stands for the days until the next one, so all is one pass over the sorted sequence and the days need no join.
    """
    others = [c for c in df.columns if c not in (seq, date)]
    sorted_rows = Window.partitionBy(seq).orderBy(date, *others)
    first = df.filter(F.col(date).isNotNull()).withColumn("__before", F.lag(date).over(sorted_rows))
    first = first.filter(F.col("__before").isNull() | (F.col("__before") < F.col(date)))
    after = F.lead(date).over(Window.partitionBy(seq).orderBy(date))
    kind = df.schema[date].dataType.typeName()
    stop = F.date_sub(after, 1) if kind == "date" else after - F.expr("interval 1 day") if kind.startswith("timestamp") else after - F.lit(1).cast(df.schema[date].dataType)
    days = first.withColumn("__stop", F.coalesce(stop, F.col(date))).withColumn("__day", F.explode(F.sequence(date, "__stop")))
    return days.select(seq, F.col("__day").alias(date), *[F.when(F.col("__day") == F.col(date), F.col(c)).alias(c) for c in others])


def locf(x: Column | str, *keys: str, by: str = "t") -> Column:
    """The last value that was not missing; leading missing values stay."""
    return F.last(col(x), True).over(up_to(*keys, by=by))


def changed(x: Column | str, over: WindowSpec) -> Column:
    """Whether a run starts here: no previous row, or another value (missing counts as a value)."""
    before = F.lag(F.struct(col(x))).over(over)
    return before.isNull() | ~F.struct(col(x)).eqNullSafe(before)


def rising(x: Column, over: WindowSpec) -> Column:
    """True where x becomes true; a missing value counts as false."""
    x = F.coalesce(x, F.lit(False))
    return x & ~F.coalesce(F.lag(x).over(over), F.lit(False))


def run_id(start: Column, *keys: str, by: str = "t") -> Column:
    """Number of the run, counted by its starts; 0 before the first."""
    return F.sum(F.coalesce(start, F.lit(False)).cast("int")).over(up_to(*keys, by=by))


def runs(df: DataFrame, x: str, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Run-length encoding: seq, run, value, first, last, length."""
    marked = df.withColumn("__new", changed(x, ordered(seq, by=t)))
    return marked.withColumn("run", run_id(F.col("__new"), seq, by=t)).groupBy(seq, "run").agg(
        F.first(x).alias("value"), F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("length")
    )


def gap_runs(df: DataFrame, missing: Column, least: int = 70, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Adds gap_id (missing outside gaps), gap_length, and gap (whether it has ``least`` days)."""
    df = df.withColumn("__m", F.coalesce(missing, F.lit(False)))
    df = df.withColumn("__run", run_id(rising(F.col("__m"), ordered(seq, by=t)), seq, by=t))
    whole = Window.partitionBy(seq, "__run", "__m")
    length = F.when(F.col("__m"), F.count(F.lit(1)).over(whole))
    df = df.withColumn("gap_id", F.when(F.col("__m"), F.col("__run"))).withColumn("gap_length", length)
    return df.withColumn("gap", F.coalesce(F.col("gap_length") >= least, F.lit(False))).drop("__m", "__run")


def longest_runs(df: DataFrame, x: str, seq: str = "seq_id", t: str = "t") -> DataFrame:
    """Longest run of each value by sequence."""
    return runs(df, x, seq, t).groupBy(seq, "value").agg(F.max("length").alias("longest"))


def places(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Adds day (1.. from the start) and day_back (-1 is the last) within each group."""
    by = Window.partitionBy(*keys)
    df = df.withColumn("day", F.row_number().over(by.orderBy(t)))
    return df.withColumn("day_back", F.col("day") - F.count(F.lit(1)).over(by) - 1)


def folded(day: Column | str, back: Column | str, least: int = -18) -> Column:
    """Day counted from the end if it is near the end, else from the start."""
    return F.when(col(back) >= least, col(back)).otherwise(col(day))


def top(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First n rows of each group by a total order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).filter(F.col("__place") <= n).drop("__place")


def ends(df: DataFrame, keys: list[str], t: str = "t", values: list[str] | None = None) -> DataFrame:
    """First and last value of columns in each group, in one aggregate."""
    values = values or [c for c in df.columns if c not in keys and c != t]
    return df.groupBy(*keys).agg(*[f(v, t).alias(f"{p}_{v}") for v in values for p, f in (("first", F.min_by), ("last", F.max_by))])


def average_overlaps(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key: mean of ``value`` over its duplicates, and whether there were any."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value), (F.count(F.lit(1)) > 1).alias("overlap"))


def windows_of(df: DataFrame, spans: DataFrame, seq: str = "seq_id", t: str = "t", start: str = "start", end: str = "end", how: str = "inner") -> DataFrame:
    """Rows with the spans that contain them: a range join behind an equi-join on the sequence."""
    spans = spans.withColumnRenamed(seq, "__seq")
    on = (F.col(seq) == F.col("__seq")) & (F.col(t) >= F.col(start)) & (F.col(t) <= F.col(end))
    return df.join(spans, on, how).drop("__seq")


def neighbours(df: DataFrame, marks: DataFrame, seq: str = "seq_id", t: str = "t", mark: str = "mark") -> DataFrame:
    """Adds previous_mark (the last at or before the row) and next_mark (the first after it).

    An as-of join by one sort of rows and marks together, without a range join.
    """
    kept = [c for c in df.columns if c not in (seq, t)]
    rows = df.select(seq, t, F.lit(1).alias("__row"), F.struct(*kept, F.lit(0).alias("__")).alias("__kept"), F.lit(None).cast(df.schema[t].dataType).alias("__mark"))
    other = marks.select(seq, F.col(mark).cast(df.schema[t].dataType).alias(t), F.lit(0).alias("__row"), F.lit(None).cast(rows.schema["__kept"].dataType).alias("__kept"), F.col(mark).cast(df.schema[t].dataType).alias("__mark"))
    both = rows.unionByName(other)
    by = Window.partitionBy(seq).orderBy(t, "__row")
    both = both.withColumn("previous_mark", F.last("__mark", True).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("next_mark", F.first("__mark", True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    return both.filter("__row = 1").select(seq, t, *[F.col("__kept")[c].alias(c) for c in kept], "previous_mark", "next_mark")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by sequence for work that is heavy for its bytes: Spark would merge such small partitions to one task.

    A number of partitions other than the usual one keeps Spark from taking an earlier exchange instead.
    """
    spark = df.sparkSession
    return df.repartition(2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1, key)
