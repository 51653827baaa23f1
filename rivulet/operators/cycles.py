"""Cycles, durations between events, and stretches of cycles that qualify for prediction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rolling import roll
from .sequence import changed, ordered, run_id
from .tracking import tracking_class

MENSES, OVULATION, LUTEAL, LOSS, BIRTH = 1, 5, 7, 12, 17


def identify_cycles(decoded: DataFrame, observed: DataFrame | None = None, ovulation: int = OVULATION, ovulatory: tuple = tuple(range(1, 8)), **classes) -> DataFrame:
    """Most likely states (seq_id, t, state, prob) -> cycles, each from one entry into menses to the next."""
    by = ordered("seq_id")
    start = (F.col("state") == MENSES) & (F.coalesce(F.lag("state").over(by) != MENSES, F.lit(True)))
    days = decoded.withColumn("cycle_number", run_id(start, "seq_id"))
    got = days.groupBy("seq_id", "cycle_number").agg(
        F.count(F.lit(1)).alias("cycle_length"), F.min("t").alias("cycle_start"), F.max("t").alias("cycle_end"), F.min("prob").alias("min_prob"), F.max("prob").alias("max_prob"),
        F.max(F.when(F.col("state") == ovulation, F.col("prob"))).alias("ovu_prob"), F.count_if(F.col("state") == ovulation).alias("n_ovu"), F.bool_and(F.col("state").isin(*ovulatory)).alias("only_ovulatory"),
    )
    got = got.withColumn("ovulatory_cycle", F.col("only_ovulatory") & (F.col("n_ovu") > 0)).drop("only_ovulatory")
    if observed is None:
        return got
    named = tracking_class(days.select("seq_id", "t", "cycle_number").join(observed, ["seq_id", "t"], "left"), ["seq_id", "cycle_number"], cycle="cycle_number", **classes)
    return got.join(named.select("seq_id", "cycle_number", "tracking_behavior"), ["seq_id", "cycle_number"], "left")


def cycle_characteristics(cycles: DataFrame, below: int = 50, seq: str = "seq_id") -> DataFrame:
    """By sequence: number of cycles, median and deviation of lengths, over all and over those below a limit."""
    short = F.when(F.col("cycle_length") < below, F.col("cycle_length"))
    return cycles.groupBy(seq).agg(
        F.count(F.lit(1)).alias("n_cycles"), F.percentile("cycle_length", 0.5).alias("median_length"), F.stddev_samp("cycle_length").alias("sd_length"),
        F.count(short).alias("n_short"), F.percentile(short, 0.5).alias("median_short"), F.stddev_samp(short).alias("sd_short"),
    )


def pair_type(before: Column, after: Column) -> Column:
    return (
        F.when((before == MENSES) & (after == MENSES), "cycle").when((before == BIRTH) & (after == MENSES), "post-partum").when((before == LOSS) & (after == MENSES), "post-loss")
        .when(after == BIRTH, "pregnancy with birth").when(after == LOSS, "pregnancy with loss").otherwise("undefined")
    )


def event_durations(decoded: DataFrame, least: float = 0.7) -> DataFrame:
    """Days between the starts of menses, losses and births that are likely enough, with the type of the time between."""
    by = ordered("seq_id")
    events = decoded.filter(F.col("state").isin(MENSES, LOSS, BIRTH) & (F.col("prob") >= least))
    starts = events.withColumn("__new", F.coalesce(F.lag("t").over(by) != F.col("t") - 1, F.lit(True))).filter("__new").drop("__new")
    out = starts.withColumns({"duration": F.col("t") - F.lag("t").over(by), "previous": F.lag("state").over(by)})
    return out.filter("duration is not null").withColumn("type", pair_type(F.col("previous"), F.col("state")))


def luteal_durations(decoded: DataFrame) -> DataFrame:
    """By ovulation: days from it to the last luteal day before menses; confident if the day before had prob >= 0.5."""
    by = ordered("seq_id")
    marked = decoded.withColumn("__new", changed("state", by)).withColumn("before", F.lag("prob").over(by))
    marked = marked.withColumn("phase", run_id((F.col("state") == OVULATION) & F.col("__new"), "seq_id"))
    luteal = F.when(F.col("state") == LUTEAL, F.col("t"))
    start = F.min(F.when(F.col("state") == OVULATION, F.col("t")))
    menses = F.min(F.when(F.col("state") == MENSES, F.col("t")))
    got = marked.filter("phase > 0").groupBy("seq_id", "phase").agg(start.alias("ovulation"), menses.alias("menses"), F.max(luteal).alias("last"), F.min_by("before", F.when(F.col("state") == MENSES, F.col("t"))).alias("prob_before"))
    return got.filter("menses is not null and last < menses").select("seq_id", "ovulation", (F.col("last") - F.col("ovulation")).alias("duration"), (F.col("prob_before") >= 0.5).alias("confident"))


def qualifying_starts(cycles: DataFrame, n: int = 5, most: float = 8, least_prob: float = 0.3, keep: tuple = (1, 6, 11, 16, 21)) -> DataFrame:
    """First cycles of runs of ``n`` regular, likely, ovulatory cycles whose lengths vary by at least ``most`` days in sum."""
    over = Window.partitionBy("seq_id").orderBy("cycle_number")
    good = ((F.col("min_prob") >= least_prob) & F.col("ovulatory_cycle") & (F.coalesce("ovu_prob", F.lit(0.0)) >= 0.5)).cast("int")
    step = F.abs(F.lead("cycle_length").over(over) - F.col("cycle_length"))
    df = cycles.filter("cycle_number > 0").withColumns({"__good": F.coalesce(good, F.lit(0)), "__step": step})
    df = df.withColumns({"all_good": roll("__good", F.sum, n, over, "left") == n, "moved": roll("__step", F.sum, n - 1, over, "left")})
    df = df.filter("all_good").filter(F.col("moved") >= most)
    df = df.withColumn("nth", F.row_number().over(over)).filter(F.col("nth").isin(*keep))
    return df.select("seq_id", F.col("cycle_number").alias("first_cycle"), "nth")


def qualifying_cycles(cycles: DataFrame, n: int = 5, **how) -> DataFrame:
    """The cycles of the qualifying runs, numbered 1..n within each."""
    starts = qualifying_starts(cycles, n, **how)
    wanted = starts.select("seq_id", "first_cycle", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    wanted = wanted.select("seq_id", "first_cycle", (F.col("first_cycle") + F.col("k")).alias("cycle_number"), (F.col("k") + 1).alias("nth_cycle"))
    return wanted.join(cycles, ["seq_id", "cycle_number"])
