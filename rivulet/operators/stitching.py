"""Decoded stretches put together as relations, and a second pass for the users whose seams are broken.

Stretches of a user are decoded apart from each other, so a panel is dealt by stretch rather than by user, and a user with
many stretches is no larger task than others. Neighbours overlap by a period: a *seam*. Where they do, probabilities are
averaged and the best state is taken. A seam is broken if a stretch that has part in it knows no menses there. Only around
these the days are decoded again: from the last sure cycle start before the seam to some days into the first one after it,
as unions of intervals where these overlap.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..hsmm.model import Model, stored
from .decode import CHANNELS, SURE, Limits, bleeding_cycles, decode_stretch
from .sequence import dealt, neighbours, windows_of
from .tracking import stretches, tracking_class

#: Days that a repair goes on after the first sure cycle start behind a seam.
AFTER = 5


def stitched(parts: DataFrame, key: str = "seq_id") -> DataFrame:
    """One row a day: key, t, state, prob, stretch_number, tracking_behavior.

    ``parts`` (key, stretch_number, tracking_behavior, t, state, prob, on_path) has the states of each day in each stretch.
    Outside seams the state on the stretch's path stays; in a seam the most probable one, of equal ones the first. There
    the stretch's number is the mean of those that meet, and its class their classes joined. Missing probabilities are last.
    """
    parts = parts.repartition(key)
    of = F.transform(F.array_sort(F.collect_list(F.struct("stretch_number", "tracking_behavior"))), lambda s: s["tracking_behavior"])
    by_state = parts.groupBy(key, "t", "state").agg(F.avg("prob").alias("prob"), F.bool_or("on_path").alias("on_path"), F.count("*").alias("n"), F.avg("stretch_number").alias("stretch_number"), F.array_join(F.array_distinct(of), "-").alias("tracking_behavior"))
    seam = F.max("n").over(Window.partitionBy(key, "t")) > 1
    by_state = by_state.withColumn("seam", seam)
    best = Window.partitionBy(key, "t").orderBy(F.desc(F.when(F.col("seam"), F.col("prob"))), "state")
    chosen = F.when(F.col("seam"), F.row_number().over(best) == 1).otherwise(F.col("on_path"))
    return by_state.withColumn("chosen", chosen).filter("chosen").select(key, "t", "state", "prob", "stretch_number", "tracking_behavior")


def seams(parts: DataFrame, menses: int = 1, key: str = "seq_id") -> DataFrame:
    """Seams: key, stretch_number (the mean of those that meet), low, high, broken."""
    day = Window.partitionBy(key, "t")
    paths = parts.filter("on_path").repartition(key).select(key, "t", "state", "stretch_number", F.avg("stretch_number").over(day).alias("seam"), (F.min("stretch_number").over(day) < F.max("stretch_number").over(day)).alias("meet"))
    sides = paths.filter("meet").groupBy(key, "seam", "stretch_number").agg(F.bool_or(F.col("state") == menses).alias("known"), F.min("t").alias("low"), F.max("t").alias("high"))
    return sides.groupBy(key, F.col("seam").alias("stretch_number")).agg(F.min("low").alias("low"), F.max("high").alias("high"), (~F.bool_and("known")).alias("broken")).select(key, "stretch_number", "low", "high", "broken")


def sure_starts(days: DataFrame, menses: int = 1, sure: float = SURE, key: str = "seq_id") -> DataFrame:
    """First days of menses that are sure: key, mark."""
    before = F.lag("state").over(Window.partitionBy(key).orderBy("t"))
    first = (F.col("state") == menses) & (before.isNull() | (before != menses))
    return days.withColumn("__first", first).filter(F.col("__first") & (F.col("prob") > sure)).select(key, F.col("t").alias("mark"))


def repairs(days: DataFrame, found: DataFrame, menses: int = 1, sure: float = SURE, key: str = "seq_id") -> DataFrame:
    """What is to be decoded again, for ``stitched`` days and their ``seams``: key, start, end, stretch_number (the least of the broken seams within)."""
    broken, starts = found.filter("broken"), sure_starts(days, menses, sure, key)
    whole = days.groupBy(key).agg(F.min("t").alias("first_day"), F.max("t").alias("last_day"))
    early = neighbours(broken.withColumn("t", F.col("low") - 1), starts, key).select(key, "stretch_number", "low", "high", F.col("previous_mark").alias("before"))
    both = neighbours(early.withColumn("t", F.col("high")), starts, key).select(key, "stretch_number", "before", F.col("next_mark").alias("after")).join(whole, key)
    both = both.select(key, "stretch_number", F.coalesce("before", "first_day").alias("start"), F.least(F.coalesce(F.col("after") + AFTER, "last_day"), "last_day").alias("end"))
    order = Window.partitionBy(key).orderBy("start", "end", "stretch_number")
    apart = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    both = both.withColumn("__new", apart.cast("int")).withColumn("__union", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return both.groupBy(key, "__union").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("stretch_number").alias("stretch_number")).drop("__union")


def replaced(days: DataFrame, spans: DataFrame, fresh: DataFrame, key: str = "seq_id") -> DataFrame:
    """``days`` outside the spans, and what was decoded afresh within them."""
    marked = windows_of(days, spans.select(key, "start", "end"), key, how="left")
    return marked.filter("start is null").select(*days.columns).unionByName(fresh.select(*days.columns))


def _decoded(rows: DataFrame, model: Model, fitted: bool, fixed_sojourns: bool) -> DataFrame:
    """All states of the days of each stretch; ``rows`` (seq_id, stretch_number, tracking_behavior, t, channels, truth, trust)."""
    text = rows.sparkSession.sparkContext.broadcast(model.to_json())
    kind = rows.schema["seq_id"].dataType.simpleString()
    channels = [c for c in CHANNELS if c in rows.columns]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        days = pdf.sort_values("t").drop_duplicates("t").reset_index(drop=True)
        labels = days.loc[days["truth"].notna(), ["t", "truth", "trust"]].rename(columns={"truth": "state"})
        got = decode_stretch(days[["t", *channels]], days["tracking_behavior"].iloc[0], stored(text.value), labels, fitted, fixed_sojourns)
        return got.assign(seq_id=days["seq_id"].iloc[0], stretch_number=days["stretch_number"].iloc[0], tracking_behavior=days["tracking_behavior"].iloc[0])

    # two keys are dealt by one that stands for both, in as many parts as heavy work needs
    spread = dealt(rows.withColumn("__of", F.xxhash64("seq_id", "stretch_number")), "__of")
    return spread.groupBy("__of", "seq_id", "stretch_number").applyInPandas(one, f"t int, state int, prob double, on_path boolean, seq_id {kind}, stretch_number double, tracking_behavior string")


def decode_by_stretch(panel: DataFrame, model: Model, bleeding: Model, key: str = "seq_id", limits: Limits = Limits(), fitted: bool = False, fixed_sojourns: bool = True) -> DataFrame:
    """The hierarchical decoding of ``decode_panel`` with a task for each stretch instead of each user: seq_id, t, state, prob, stretch_number, tracking_behavior."""
    channels = [c for c in CHANNELS if c in panel.columns]
    days = panel.filter(F.col(key).isNotNull()).select(F.col(key).alias("seq_id"), "t", *channels).dropDuplicates(["seq_id", "t"])
    text, kind = panel.sparkSession.sparkContext.broadcast(bleeding.to_json()), panel.schema[key].dataType.simpleString()
    menses = model.state("M")

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        got = bleeding_cycles(pdf.sort_values("t").reset_index(drop=True), stored(text.value))
        return got.assign(seq_id=pdf["seq_id"].iloc[0])[["seq_id", "t", "state", "prob", "menses", "cycle"]]

    by_bleeding = dealt(days.select("seq_id", "t", "bleeding"), "seq_id").groupBy("seq_id").applyInPandas(alone, f"seq_id {kind}, t int, state int, prob double, menses boolean, cycle long")
    anchor = F.when((F.col("state").isin([menses] + ([model.state("B")] if "B" in model.names else []))) & (F.col("prob") > SURE), F.col("state"))
    marked = days.join(by_bleeding.select("seq_id", "t", "menses", "cycle", anchor.alias("truth"), F.lit(SURE).alias("trust")), ["seq_id", "t"]).persist()
    for c in ("mucus", "temp", "LH", "preg"):
        if c not in channels:
            marked = marked.withColumn(c, F.lit(None).cast("double" if c == "temp" else "string"))
    spans = stretches(marked, limits.mucus, limits.temp).select("seq_id", F.col("stretch_number").cast("double").alias("stretch_number"), "tracking_behavior", "start", "end")
    whole = marked.groupBy("seq_id").agg(F.min("t").alias("start"), F.max("t").alias("end")).join(tracking_class(marked, ["seq_id"], mucus=limits.mucus, temp=limits.temp).select("seq_id", "tracking_behavior"), "seq_id")
    lone = whole.join(spans.select("seq_id").distinct(), "seq_id", "left_anti").select("seq_id", F.lit(1.0).alias("stretch_number"), "tracking_behavior", "start", "end")
    rows = windows_of(marked.select("seq_id", "t", *channels, "truth", "trust"), spans.unionByName(lone)).drop("start", "end")
    parts = _decoded(rows, model, fitted, fixed_sojourns).persist()
    out = stitched(parts)
    again = repairs(out, seams(parts, menses), menses).persist()
    inside = windows_of(marked, again)
    kinds = tracking_class(inside, ["seq_id", "start"], mucus=limits.mucus, temp=limits.temp).select("seq_id", "start", "tracking_behavior")
    sure = sure_starts(out, menses).select("seq_id", F.col("mark").alias("t"), F.lit(True).alias("__sure"))
    inside = inside.join(kinds, ["seq_id", "start"]).join(sure, ["seq_id", "t"], "left")
    edge = F.col("__sure") & ((F.col("t") == F.col("start")) | (F.col("t") == F.col("end") - AFTER))
    inside = inside.withColumn("truth", F.when(edge, F.lit(menses))).withColumn("trust", F.lit(1.0))
    fresh = _decoded(inside.select("seq_id", "stretch_number", "tracking_behavior", "t", *channels, "truth", "trust"), model, fitted, fixed_sojourns).filter("on_path")
    return replaced(out, again, fresh)
