"""Scores of predicted labels and forecasts against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import weighted_mean
from .tables import share_within


def labelled(truth: DataFrame, predicted: DataFrame, keys: tuple = ("seq_id", "t")) -> DataFrame:
    """Rows of either side: keys, truth, state, prob; rows that only one side has drop out of the scores by themselves."""
    return truth.withColumnRenamed("state", "truth").join(predicted, list(keys), "full")


def _hit() -> Column:
    return (F.col("state") == F.col("truth")).cast("double")


def accuracy(pairs: DataFrame, by: tuple = ()) -> DataFrame:
    """Share of equal labels, plain and weighted by the probability of the prediction."""
    return pairs.groupBy(*by).agg(F.avg(_hit()).alias("accuracy"), weighted_mean(_hit(), "prob").alias("weighted_accuracy"), F.count(_hit()).alias("n"))


def accuracy_by_state(pairs: DataFrame) -> DataFrame:
    return accuracy(pairs.filter("truth is not null"), ("truth",))


def mean_of_states(pairs: DataFrame) -> DataFrame:
    """Mean over the states of their accuracies, so that rare ones count as much."""
    return accuracy_by_state(pairs).agg(F.avg("accuracy").alias("mean_accuracy"))


def accuracy_by_groups(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Accuracy for each value of each of the columns, in one aggregate."""
    long = pairs.withColumn("__hit", _hit()).select("__hit", "prob", F.explode(F.array(*[F.struct(F.lit(c).alias("group"), F.col(c).cast("string").alias("value")) for c in columns])).alias("g"))
    return long.groupBy("g.group", "g.value").agg(F.avg("__hit").alias("accuracy"), weighted_mean("__hit", "prob").alias("weighted_accuracy"), F.count("__hit").alias("n"))


def confusion(pairs: DataFrame) -> DataFrame:
    """For each true state: how often each state was predicted, plain and by weight of probability."""
    both = pairs.filter("truth is not null and state is not null")
    plain = share_within(both, ["truth", "state"], ["truth"])
    heavy = share_within(both, ["truth", "state"], ["truth"], "prob", "weighted_share").withColumnRenamed("n", "weight")
    return plain.join(heavy, ["truth", "state"])


def forecast_errors(pairs: DataFrame, predicted: str, actual: str, by: tuple = ()) -> DataFrame:
    """Mean squared error, its root, mean absolute error and share of misses."""
    d = F.col(predicted) - F.col(actual)
    return pairs.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.avg((d != 0).cast("double")).alias("missed"))


def ratio_forecast_errors(pairs: DataFrame, total: str, count: str, actual: str, by: tuple = ()) -> DataFrame:
    """As ``forecast_errors`` for forecasts total / count of whole numbers, the same whatever the order of the rows.

    The errors of one ``count`` have it as their common denominator, so their numerators add up exactly; what is left, one
    term for each count, is added in its order. Rows without a forecast (count 0 or missing) are left out.
    """
    exact = lambda x: F.col(x).cast("decimal(18,0)")
    off = exact(total) - exact(actual) * exact(count)
    terms = pairs.filter(F.col(count) > 0).groupBy(*by, count).agg(
        F.sum(off * off).cast("double").alias("squares"), F.sum(F.abs(off)).cast("double").alias("sizes"), F.count(off).alias("n"), F.sum((off != 0).cast("long")).alias("wrong")
    )
    terms = terms.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(count).alias("k"), "squares", "sizes"))).alias("terms"), F.sum("n").alias("n"), F.sum("wrong").alias("wrong"))
    add = lambda x, power: F.aggregate("terms", F.lit(0.0), lambda acc, e: acc + e[x] / F.pow(e["k"].cast("double"), F.lit(power)))
    mse = add("squares", 2.0) / F.col("n")
    return terms.select(*by, mse.alias("mse"), F.sqrt(mse).alias("rmse"), (add("sizes", 1.0) / F.col("n")).alias("mae"), (F.col("wrong") / F.col("n")).alias("missed"))


def missingness_error(p_missing: Column, missing: Column) -> Column:
    """How wrong a forecast probability of a missing value was."""
    return F.when(missing, 1 - p_missing).otherwise(p_missing)


def nearest_events(truth: DataFrame, found: DataFrame, within: int = 15) -> DataFrame:
    """For each true event (seq_id, t, state): offset of the nearest found event of that state, missing if none is near.

    A range join on keys of ``within`` days, so each event meets its own and the two neighbouring cells only.
    """
    a = truth.select("seq_id", "state", F.col("t").alias("true_t")).distinct()
    a = a.withColumn("cell", F.explode(F.array(*[F.floor(F.col("true_t") / within) + k for k in (-1, 0, 1)])))
    b = found.select("seq_id", "state", F.col("t").alias("found_t"), F.floor(F.col("t") / within).alias("cell")).distinct()
    d = F.col("found_t") - F.col("true_t")
    near = a.join(b, ["seq_id", "state", "cell"], "left").withColumn("d", F.when(F.abs(d) <= within, d))
    return near.groupBy("seq_id", "state", "true_t").agg(F.min_by("d", F.when(F.col("d").isNotNull(), F.struct(F.abs("d"), "d"))).alias("offset"))


def side_by_side(models: dict[str, DataFrame], keys: tuple = ("seq_id", "t")) -> DataFrame:
    """States and probabilities of several models by day."""
    from .tables import full_join_all

    return full_join_all({k: v.select(*keys, "state", "prob") for k, v in models.items()}, list(keys))


def wrong_share(pairs: DataFrame, seq: str = "seq_id") -> DataFrame:
    return pairs.groupBy(seq).agg((1 - F.avg(_hit())).alias("wrong"))


def share_of_group_max(df: DataFrame, keys: list[str], value: str, step: float) -> DataFrame:
    """Histogram of a rounded value, each bar relative to the highest of its group."""
    counted = df.groupBy(*keys, (F.bround(F.col(value) / step) * step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("relative", F.col("n") / F.max("n").over(Window.partitionBy(*keys)))
