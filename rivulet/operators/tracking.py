"""How a user tracks: a class for each cycle, and stretches of cycles of one class."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sequence import changed, ordered, run_id

CLASSES = ("B", "BP", "BLH", "BT", "BM", "BTM")


def tracking_class(df: DataFrame, by: list[str], cycle: str = "cycle", mucus: int = 5, temp: int = 8) -> DataFrame:
    """The class of each group by the number of its reports for each of its cycles."""
    counts = [F.count(c).alias(f"n_{c}") for c in ("mucus", "temp", "LH", "preg")]
    got = df.groupBy(*by).agg((F.count_distinct(cycle) + F.max(F.col(cycle).isNull().cast("int"))).alias("n_cycles"), *counts)
    many_mucus, many_temp = F.col("n_mucus") >= mucus * F.col("n_cycles"), F.col("n_temp") >= temp * F.col("n_cycles")
    name = F.when(many_mucus & many_temp, "BTM").when(many_mucus, "BM").when(many_temp, "BT").when(F.col("n_LH") >= F.col("n_cycles"), "BLH").when(F.col("n_preg") >= F.col("n_cycles"), "BP").otherwise("B")
    return got.withColumn("tracking_behavior", name)


def stretches(days: DataFrame, mucus: int = 5, temp: int = 8) -> DataFrame:
    """``days`` (seq_id, t, cycle, menses, channels) -> stretches of cycles of one class: start, end, length.

    A stretch goes on over the next one's first period, so that neighbours overlap there.
    """
    of_cycle = tracking_class(days, ["seq_id", "cycle"], mucus=mucus, temp=temp).select("seq_id", "cycle", "tracking_behavior")
    new = F.coalesce(F.lag("menses").over(ordered("seq_id", "cycle")) != F.col("menses"), F.lit(True))
    runs = days.select("seq_id", "t", "cycle", F.coalesce("menses", F.lit(False)).alias("menses")).withColumn("__new", new)
    runs = runs.withColumn("__run", run_id(F.col("__new"), "seq_id", "cycle"))
    first = F.sum(((F.col("__run") == 1) & F.col("menses")).cast("int")).alias("period")
    spans = runs.groupBy("seq_id", "cycle").agg(F.min("t").alias("start"), F.max("t").alias("end"), first).join(of_cycle, ["seq_id", "cycle"])
    by = ordered("seq_id", by="cycle")
    spans = spans.withColumn("__new", changed("tracking_behavior", by)).withColumn("stretch_number", run_id(F.col("__new"), "seq_id", by="cycle"))
    whole = spans.groupBy("seq_id", "stretch_number").agg(F.first("tracking_behavior").alias("tracking_behavior"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("period", "cycle").alias("period"))
    following = F.coalesce(F.lead("period").over(Window.partitionBy("seq_id").orderBy("stretch_number")), F.lit(0))
    whole = whole.withColumn("end", F.col("end") + following).drop("period").withColumn("length", F.col("end") - F.col("start"))
    return whole.filter("length > 0")


def tracking_frequency(df: DataFrame, channels: list[str], seq: str = "seq_id") -> DataFrame:
    """By sequence: share of filled cells over all channels, and of days with any report."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in channels), F.lit(0))
    return df.groupBy(seq).agg((F.sum(filled) / (len(channels) * F.count(F.lit(1)))).alias("filled"), F.avg((filled > 0).cast("double")).alias("any_log"))


def missingness(df: DataFrame, channels: list[str], seq: str = "seq_id") -> DataFrame:
    """Over users: mean, median, least, 5 %, 95 % and most of each channel's share of days with a value."""
    each = df.groupBy(seq).agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in channels])
    long = each.unpivot([seq], channels, "channel", "freq")
    return long.groupBy("channel").agg(
        F.avg("freq").alias("mean"), F.percentile("freq", 0.5).alias("median"), F.min("freq").alias("min"), F.percentile("freq", 0.05).alias("p05"), F.percentile("freq", 0.95).alias("p95"), F.max("freq").alias("max")
    )
