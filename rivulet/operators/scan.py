"""Scans of sequences that are too long for one task: blocks of days first, then what goes over from block to block.

A sequence is cut into blocks of ``size`` days. Rows are dealt by sequence and block, so no task has to take a whole
sequence, however many of the rows are its own. Within a block a scan is a window. Each block then leaves one row, the
blocks of a sequence are scanned in turn, and their carries are joined back to the days. The results are those of a window
over the whole sequence. Days must be whole numbers and distinct within a sequence; rows without a sequence or a day are
left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col
from ..sources.io import checkpointed

#: Days in a block.
SIZE = 4096
_BLOCK = "__block"


def _cut(df: DataFrame, seq: str, t: str, size: int) -> DataFrame:
    return df.filter(F.col(seq).isNotNull() & F.col(t).isNotNull()).withColumn(_BLOCK, F.floor(F.col(t) / size))


def scanned(df: DataFrame, sums: dict[str, Column | str] | None = None, lasts: dict[str, Column | str] | None = None, before: dict[str, Column | str] | None = None, runs: dict[str, Column | str] | None = None, seq: str = "seq_id", t: str = "t", size: int = SIZE) -> DataFrame:
    """Adds columns by their new names: running ``sums``, ``lasts`` (the last value that was not missing), values of the row
    ``before``, and ids of ``runs`` of one value, from 1; a missing value is a value of its own.

    Sums of missing values alone are missing, as they are over a window. A sequence's blocks, one row for each, come to
    one task.
    """
    sums, lasts, before, runs = ({k: col(v) for k, v in (x or {}).items()} for x in (sums, lasts, before, runs))
    inner = Window.partitionBy(seq, _BLOCK).orderBy(t)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    kept = df.columns
    df = _cut(df, seq, t, size).withColumns({f"__x_{k}": F.struct(c.alias("v")) for k, c in (before | runs).items()})
    new = lambda k: ~F.col(f"__x_{k}").eqNullSafe(F.lag(f"__x_{k}").over(inner)) & F.lag(f"__x_{k}").over(inner).isNotNull()  # noqa: E731  a change within the block
    df = df.withColumns({f"__s_{k}": F.sum(c).over(upto) for k, c in sums.items()} | {f"__l_{k}": F.last(c, True).over(upto) for k, c in lasts.items()} | {f"__b_{k}": F.lag(f"__x_{k}").over(inner) for k in before} | {f"__n_{k}": new(k).cast("long") for k in runs})
    df = df.withColumns({f"__n_{k}": F.sum(f"__n_{k}").over(upto) for k in runs})

    at_end = [F.max_by(f"__{p}_{k}", t).alias(f"__{p}_{k}") for p, names in (("s", sums), ("l", lasts), ("n", runs), ("x", before | runs)) for k in names]
    blocks = df.groupBy(seq, _BLOCK).agg(*at_end, *[F.min_by(f"__x_{k}", t).alias(f"__f_{k}") for k in runs])
    outer = Window.partitionBy(seq).orderBy(_BLOCK)
    past = outer.rowsBetween(Window.unboundedPreceding, -1)
    # a run begins with a block if the block before ended with another value, or if there is none
    blocks = blocks.withColumns({f"__e_{k}": (F.lag(f"__x_{k}").over(outer).isNull() | ~F.col(f"__f_{k}").eqNullSafe(F.lag(f"__x_{k}").over(outer))).cast("long") for k in runs})
    carries = blocks.select(
        seq, _BLOCK, *[F.sum(f"__s_{k}").over(past).alias(f"__cs_{k}") for k in sums], *[F.last(f"__l_{k}", True).over(past).alias(f"__cl_{k}") for k in lasts],
        *[F.lag(f"__x_{k}").over(outer).alias(f"__cb_{k}") for k in before], *[(F.coalesce(F.sum(F.col(f"__n_{k}") + F.col(f"__e_{k}")).over(past), F.lit(0)) + F.col(f"__e_{k}")).alias(f"__cn_{k}") for k in runs],
    )
    joined = df.join(carries, [seq, _BLOCK])
    own, over = lambda p, k: F.col(f"__{p}_{k}"), lambda p, k: F.col(f"__c{p}_{k}")
    return joined.select(
        *kept,
        *[F.coalesce(own("s", k) + over("s", k), own("s", k), over("s", k)).alias(k) for k in sums], *[F.coalesce(own("l", k), over("l", k)).alias(k) for k in lasts],
        *[F.coalesce(own("b", k), over("b", k))["v"].alias(k) for k in before], *[(own("n", k) + over("n", k)).alias(k) for k in runs],
    )


Combine = Callable[[list[Column], list[Column]], list[Column]]


def composed(df: DataFrame, values: list[Column], combine: Combine, seq: str = "seq_id", t: str = "t", size: int = 256, names: list[str] | None = None) -> DataFrame:
    """Adds the running composition of a tuple of ``values`` under any associative ``combine(earlier, later)``, as ``names``.

    Within a block it is found by doubling: after the k-th window a row has the composition of the last 2**k rows, so
    log2(size) windows over one sort do. The blocks' compositions are a shorter sequence, which is composed in the same
    way, until a sequence is a single block; no task ever has more than ``size`` rows of one sequence to order. Each such
    table of blocks, ``size`` times shorter, is written to the checkpoint folder, so that the plan does not double by level.
    """
    names = names or [f"c{k}" for k in range(len(values))]
    low, high = df.agg(F.min(t), F.max(t)).first()
    kept = df.columns
    df = df.filter(F.col(seq).isNotNull() & F.col(t).isNotNull()).withColumns(dict(zip(names, values, strict=True)))
    if low is None:
        return df.select(*kept, *names)
    return _composed(df.withColumn("__at", (F.col(t) - low).cast("long")), names, combine, seq, int(high) - int(low) + 1, size).drop("__at")


def _composed(df: DataFrame, names: list[str], combine: Combine, seq: str, span: int, size: int) -> DataFrame:
    df = df.withColumn(_BLOCK, F.call_function("div", F.col("__at"), F.lit(size).cast("long")))
    by, step = Window.partitionBy(seq, _BLOCK).orderBy("__at"), 1
    while step < min(size, span):
        df = df.withColumn("__early", F.lag(F.struct(*names), step).over(by))
        both = combine([F.col("__early")[n] for n in names], [F.col(n) for n in names])
        df = df.withColumns({n: F.when(F.col("__early").isNull(), F.col(n)).otherwise(c) for n, c in zip(names, both, strict=True)}).drop("__early")
        step *= 2
    if span <= size:
        return df.drop(_BLOCK)
    blocks = df.groupBy(seq, F.col(_BLOCK).alias("__at")).agg(F.max_by(F.struct(*names), "__at").alias("__last")).select(seq, "__at", *[F.col("__last")[n].alias(n) for n in names])
    # the carry of a block is what the last block before it that has rows has composed
    blocks = _composed(checkpointed(blocks), names, combine, seq, -(-span // size), size)
    carries = _following(blocks, names, seq, size)
    df = df.join(carries, [seq, _BLOCK], "left")
    both = combine([F.col("__carry")[n] for n in names], [F.col(n) for n in names])
    return df.withColumns({n: F.when(F.col("__carry").isNull(), F.col(n)).otherwise(c) for n, c in zip(names, both, strict=True)}).drop("__carry", _BLOCK)


def _following(blocks: DataFrame, names: list[str], seq: str, size: int) -> DataFrame:
    """For each block, the composition up to the block before it, by the same blocked scan of the row before."""
    held = blocks.withColumn("__value", F.struct(*names))
    got = scanned(held.select(seq, "__at", "__value"), before={"__carry": "__value"}, seq=seq, t="__at", size=size)
    return got.select(seq, F.col("__at").alias(_BLOCK), "__carry").filter(F.col("__carry").isNotNull())


def cheapest(a: list[Column], b: list[Column]) -> list[Column]:
    """The product of two square matrices, by rows, in the algebra of minimum and sum."""
    n = round(len(a) ** 0.5)
    return [F.least(*[a[i * n + k] + b[k * n + j] for k in range(n)]) for i in range(n) for j in range(n)]


def path_costs(df: DataFrame, steps: list[list[int]], costs: list[Column], first: Column, seq: str = "seq_id", t: str = "t", size: int = 256) -> DataFrame:
    """Adds ``cost0``, ``cost1``, ...: the least cost of a path of states from the ``first`` row to this one that ends in each state.

    ``steps[i][j]`` is the cost of going from state i to j, ``costs[j]`` that of the row's reports in j. A row is a matrix
    that takes the costs before it to those after it; the first row's has no step. A path is the product of its rows'
    matrices, and products may be taken in any grouping.
    """
    n = len(steps)
    rows = [F.when(first, costs[j]).otherwise(costs[j] + steps[i][j]).cast("long") for i in range(n) for j in range(n)]
    names = [f"__m{i}_{j}" for i in range(n) for j in range(n)]
    kept = df.columns
    got = composed(df, rows, cheapest, seq, t, size, names)
    return got.select(*kept, *[F.least(*[F.col(f"__m{i}_{j}") for i in range(n)]).alias(f"cost{j}") for j in range(n)])
