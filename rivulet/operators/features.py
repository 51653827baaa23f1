"""Features of a day in its sequence; each builder takes and returns a panel (seq_id, t, bleeding, mucus, temp, LH, preg)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.columns import clamp, lookup, rescale, sigmoid
from .rolling import roll
from .sequence import dealt, gap_runs, ordered, rising, run_id

SCORES = {"none": 0.0, "spotting": 0.25, "light": 0.5, "medium": 0.75, "heavy": 1.0}


def _w() -> WindowSpec:
    return ordered("seq_id")


def _whole() -> WindowSpec:
    return Window.partitionBy("seq_id")


def bleeding_score(df: DataFrame) -> DataFrame:
    return df.withColumn("bleeding_score", F.coalesce(lookup("bleeding", SCORES), F.lit(0.0)))


def dtemp(df: DataFrame) -> DataFrame:
    """Whether the weekly mean temperature differs by half a degree from that of 13 days before."""
    mean = roll("temp", F.avg, 7, _w())
    d = F.col("__m") - F.lag("__m", 13).over(_w())
    label = F.when(d.isNull(), "missing").when(d >= 0.5, "increase").when(d <= -0.5, "decrease").otherwise("no_change")
    return df.withColumn("__m", mean).withColumn("dtemp", label).drop("__m")


def dtemp_continuous(df: DataFrame) -> DataFrame:
    """The change of the weekly mean over six days, in units of the earlier week's deviation, on an asinh scale."""
    df = df.withColumns({"__m": roll("temp", F.avg, 7, _w()), "__s": roll("temp", F.stddev_samp, 7, _w())})
    before, sd = F.coalesce(F.lag("__m", 6).over(_w()), F.lit(-0.25)), F.coalesce(F.lag("__s", 6).over(_w()), F.lit(0.2))
    value = F.asinh((F.col("__m") - before) / F.greatest(sd, F.lit(0.1)))
    return df.withColumn("dtemp_continuous", F.coalesce(value, F.lit(0.0))).drop("__m", "__s")


def bleeding_last_week(df: DataFrame) -> DataFrame:
    bled = (F.col("bleeding_score") > 0).cast("double")
    return df.withColumn("f.bleeding.last.week", roll(bled, F.avg, 7, _w(), fill=0.0))


def bleeding_density_5d(df: DataFrame) -> DataFrame:
    return df.withColumn("bleeding_density_5d", roll("bleeding_score", F.avg, 5, _w(), "center", 0.0))


def interbleeding_id(df: DataFrame) -> DataFrame:
    """Intervals that begin on the last day before bleeding by the user's own standard."""
    q = F.percentile(F.when(F.col("bleeding_score") > 0, F.col("bleeding_score")), 0.8).over(_whole())
    df = df.withColumn("__b", F.col("bleeding_score") >= F.when(q > 0.5, 0.5).otherwise(0.25))
    start = ~F.col("__b") & F.coalesce(F.lead("__b").over(_w()), F.lit(False))
    return df.withColumn("interbleeding_id", run_id(start, "seq_id")).drop("__b")


def susp_ano(df: DataFrame) -> DataFrame:
    """How much an interval between bleedings looks as if it had no ovulation: low temperatures at its end, or light bleeding."""
    by = Window.partitionBy("seq_id", "interbleeding_id")
    place, n = F.row_number().over(by.orderBy("t")), F.count(F.lit(1)).over(by)
    df = df.withColumns({"__place": place, "__back": n - place})
    used = (F.col("bleeding_score") <= 0.25) & (F.col("__place") > 5)
    low = F.avg(F.when(used & (F.col("__back") < 10), sigmoid(-F.col("temp"), 10.0, 0.0))).over(by)
    light = F.avg(F.when(used, (F.col("bleeding_score") > 0).cast("double"))).over(by)
    high_days = F.sum(F.when(used, (F.col("temp") > 0.3).cast("int"))).over(by)
    long_enough = (F.count(F.when(used, 1)).over(by) >= 3).cast("double")
    score = F.greatest(low, rescale(light, F.lit(0.0), F.lit(1.0))) * long_enough * (F.coalesce(high_days, F.lit(0)) <= 10).cast("double")
    return df.withColumn("susp_ano", F.coalesce(clamp(score, 0.0, 1.0), F.lit(0.0))).drop("__place", "__back")


def long_high_temp(df: DataFrame, n: int = 22) -> DataFrame:
    """1 where temperatures have stayed in the upper part of the user's range for ``n`` days."""
    frame = _w().rowsBetween(1 - n, 0)
    p = {k: F.percentile("temp", k / 100).over(_whole()) for k in (20, 80)}
    within = {k: F.percentile("temp", k / 100).over(frame) for k in (15, 25, 85)}
    known = F.when(F.col("temp").isNotNull(), F.col("t"))
    df = df.withColumn("__gap", known - F.last(known, True).over(_w().rowsBetween(Window.unboundedPreceding, -1)))
    full = F.count(F.lit(1)).over(frame) == n
    range_ = p[80] - p[20]
    ok = full & (F.coalesce(F.max("__gap").over(frame), F.lit(99)) <= 3) & (F.size(F.collect_set("temp").over(frame)) >= 4)
    ok = ok & (within[25] >= p[20] + 0.7 * range_) & (F.abs(within[85] - within[15]) <= 0.5 * range_)
    return df.withColumn("long_high_temp", F.coalesce(ok, F.lit(False)).cast("int")).drop("__gap")


def m_return(df: DataFrame) -> DataFrame:
    """1 where cycles are back to the user's usual length: this interval and the next are near the median."""
    lengths = df.groupBy("seq_id", "interbleeding_id").agg(F.count(F.lit(1)).alias("__n"))
    usual = F.percentile(F.when(F.col("__n").between(15, 100), F.col("__n")), 0.5).over(_whole())
    away = F.abs(F.col("__n") - usual) / usual
    after = F.lead("__away").over(Window.partitionBy("seq_id").orderBy("interbleeding_id"))
    lengths = lengths.withColumn("__away", away).withColumn("__sum", F.col("__away") + F.coalesce(after, F.lit(0.0)))
    lengths = lengths.withColumn("m_return", F.coalesce((F.col("__away") <= 0.5) & (F.col("__sum") <= 0.5), F.lit(False)).cast("int"))
    return df.join(lengths.select("seq_id", "interbleeding_id", "m_return"), ["seq_id", "interbleeding_id"])


def preg_hint(df: DataFrame, days: int = 560) -> DataFrame:
    """How much speaks for a pregnancy: 1 from a trigger on, until signs to the contrary; 1.2 on the day itself.

    A trigger is the first positive test or long high temperature in 21 days. Bleeding by day 14 cancels it, each
    negative test or new period halves it, and regular cycles or a positive LH test after day 273 end it.
    """
    hit = (F.coalesce(F.col("preg") == "pos", F.lit(False)) | (F.col("long_high_temp") == 1)).cast("int")
    df = df.withColumn("__x", hit)
    df = df.withColumn("__trigger", ((F.col("__x") == 1) & (F.sum("__x").over(_w().rowsBetween(-20, 0)) == 1)).cast("int"))
    df = df.withColumn("__id", run_id(F.col("__trigger") == 1, "seq_id"))
    of = Window.partitionBy("seq_id", "__id").orderBy("t")
    upto = of.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__day", F.when(F.col("__id") > 0, F.row_number().over(of) - 1))
    over_ = (F.col("m_return") == 1) | ((F.col("LH") == "pos") & (F.col("__day") > 273))
    ended = F.max(F.coalesce(over_ & (F.col("__day") > 0), F.lit(False)).cast("int")).over(upto)
    period = rising(F.col("bleeding_density_5d") >= 0.5, of) & (F.col("__day") > 0)
    doubts = F.sum((F.coalesce(F.col("preg") == "neg", F.lit(False)) | F.coalesce(period, F.lit(False))).cast("int")).over(upto)
    early = (F.col("bleeding_score") >= 0.5) & (F.col("__day") <= 14)
    value = F.when(F.col("__day").isNull() | (F.col("__day") >= days) | (ended == 1) | early, 0.0).when(F.col("__day") == 0, 1.2).otherwise(1 / F.pow(F.lit(2.0), doubts))
    return df.withColumn("preg_hint", value).drop("__x", "__trigger", "__id", "__day")


def tracking(df: DataFrame) -> DataFrame:
    """Whether anything is reported; any bleeding label counts, "none" too."""
    return df.withColumn("tracking", F.coalesce(*["bleeding", "mucus", "LH", "preg", F.col("temp").cast("string")]).isNotNull())


def gap_days(df: DataFrame, least: int = 70) -> DataFrame:
    return gap_runs(df, ~F.col("tracking"), least).withColumnRenamed("gap", f"gap_{least}d").drop("gap_id", "gap_length")


def best_autocorrelation(df: DataFrame, x: str = "bleeding_score", low: int = 23, high: int = 45, span: int = 100) -> DataFrame:
    """Highest autocorrelation over lags low..high in a centred window of ``span`` rows, and its lag; missing where the window has missing or only equal values."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        v, best, lag = pdf[x].to_numpy(float), np.full(len(pdf), np.nan), np.full(len(pdf), np.nan)
        if len(v) >= span:
            total = lambda y: np.concatenate(([0.0], np.cumsum(y)))
            unknown, v = total(np.isnan(v)), np.nan_to_num(v)
            ones, squares = total(v), total(v * v)
            begin = np.arange(len(v) - span + 1)
            mean = (ones[begin + span] - ones[begin]) / span
            power = squares[begin + span] - squares[begin] - span * mean**2
            scores = np.empty((high - low + 1, len(begin)))
            for n in range(low, high + 1):  # sums of products n apart within each window, from sums over the whole sequence
                both = total(v[n:] * v[:-n])
                late, early = ones[begin + span] - ones[begin + n], ones[begin + span - n] - ones[begin]
                scores[n - low] = both[begin + span - n] - both[begin] - mean * (late + early) + (span - n) * mean**2
            some = (unknown[begin + span] == unknown[begin]) & (power > 1e-9 * np.maximum(squares[begin + span] - squares[begin], 1e-300))
            at = begin[some] + span // 2
            scores = scores[:, some] / power[some]
            best[at], lag[at] = scores.max(axis=0), low + np.round(scores, 9).argmax(axis=0)
        return pd.DataFrame({"seq_id": pdf["seq_id"], "t": pdf["t"], "acf": best, "acf_lag": lag})

    kinds = {c: df.schema[c].dataType.simpleString() for c in ("seq_id", "t")}
    return dealt(df.select("seq_id", "t", x), "seq_id").groupBy("seq_id").applyInPandas(one, f"seq_id {kinds['seq_id']}, t {kinds['t']}, acf double, acf_lag double")


#: Feature -> (builder, features that it needs), in an order that satisfies the needs.
FEATURES: dict[str, tuple[Callable[[DataFrame], DataFrame], tuple[str, ...]]] = {
    "bleeding_score": (bleeding_score, ()),
    "dtemp": (dtemp, ()),
    "dtemp_continuous": (dtemp_continuous, ()),
    "f.bleeding.last.week": (bleeding_last_week, ("bleeding_score",)),
    "bleeding_density_5d": (bleeding_density_5d, ("bleeding_score",)),
    "interbleeding_id": (interbleeding_id, ("bleeding_score",)),
    "susp_ano": (susp_ano, ("bleeding_score", "interbleeding_id")),
    "long_high_temp": (long_high_temp, ()),
    "m_return": (m_return, ("interbleeding_id",)),
    "preg_hint": (preg_hint, ("bleeding_score", "bleeding_density_5d", "long_high_temp", "m_return")),
    "tracking": (tracking, ()),
    "gap_70d": (gap_days, ("tracking",)),
}


def augment(df: DataFrame, names: list[str]) -> DataFrame:
    """The panel with these features; what they need is computed first and only kept if asked for."""
    unknown = [n for n in names if n not in FEATURES]
    if unknown:
        raise ValueError(f"no such features: {unknown}")
    needed: set[str] = set()

    def need(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in FEATURES[name][1]:
                need(other)

    for n in names:
        need(n)
    own = df.columns
    for name, (build, _) in FEATURES.items():
        if name in needed:
            df = build(df)
    return df.select(*own, *[f"`{n}`" for n in names])
