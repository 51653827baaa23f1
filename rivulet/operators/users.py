"""Simulated users: traits, tracking habits, and records with what they do not report."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..hsmm.cycle_model import cycle_model, dedicated, with_effort
from ..hsmm.dist import gamma, normalised
from ..hsmm.model import Model, Normal, stored
from ..hsmm.simulate import simulate
from .sequence import dealt

LEVELS = {"rare": 0.2, "occasional": 0.4, "expected": 0.6, "diligent": 0.8, "persistent": 1.0}
HABITS = {"b": ["bleeding"], "bp": ["bleeding", "preg"], "btm": ["bleeding", "temp", "mucus"], "full": ["bleeding", "mucus", "temp", "LH", "preg"]}


def traits(n: int, seed: int = 0) -> pd.DataFrame:
    """``n`` users for each level of effort: habit, spread of temperatures, and lengths of the phases."""
    rng, rows = np.random.default_rng(seed), []
    for level, effort in LEVELS.items():
        for k in range(n):
            rows.append((f"{level}-{k}", level, effort, str(rng.choice(list(HABITS))), float(rng.uniform(0.1, 0.3)), float(rng.normal(6, 2)), float(rng.uniform(1, 4)), float(rng.normal(11, 1)), float(rng.uniform(0.5, 2))))
    return pd.DataFrame(rows, columns=["seq_id", "alpha_level", "alpha", "tracking_category", "temp_sd", "mean_lE_sojourn", "sd_lE_sojourn", "mean_Lut_sojourn", "sd_Lut_sojourn"])


def model_of(user, base: Model | None = None) -> Model:
    """The model of one user, by their traits."""
    model = with_effort(dedicated(base or cycle_model()), user.alpha)
    d, days = model.sojourn.copy(), np.arange(1, len(model.sojourn) + 1)
    for state, mean, sd, low, high in (("lE", user.mean_lE_sojourn, user.sd_lE_sojourn, 1, 29), ("Lut", user.mean_Lut_sojourn, user.sd_Lut_sojourn, 7, 17)):
        mean = float(np.clip(mean, low + 0.5, high - 0.5))
        w = np.where((days >= low) & (days <= high), gamma(len(days), (mean / sd) ** 2, sd * sd / mean), 0)
        if w.sum() > 0:
            d[:, model.names.index(state)] = normalised(w)
    temp = model.emission["temp"]
    return replace(model, sojourn=d, emission={**model.emission, "temp": Normal(temp.mean, np.maximum(temp.sd, 0) * user.temp_sd / 0.2)})


def masked(days: pd.DataFrame, habit: str, rng: np.random.Generator) -> pd.DataFrame:
    """What a user of this habit reports; at each period there is an even chance to change to full tracking or back."""
    start = (days["state"] == 1) & (days["state"].shift() != 1)
    full = pd.Series(False, index=days.index)
    now = False
    for k in days.index[start]:
        now = bool(rng.random() < 0.5)
        full.loc[k:] = now
    out = days.copy()
    for c in HABITS["full"]:
        if c not in HABITS[habit] and c in out:
            out.loc[~full, c] = None
    return out


def simulate_users(spark: SparkSession, n: int = 50, transitions: int = 100, seed: int = 0) -> DataFrame:
    """Records of all simulated users with their traits; each is drawn from a seed of its own."""
    users = traits(n, seed)
    users["number"] = np.arange(len(users))
    base = spark.sparkContext.broadcast(cycle_model().to_json())
    kinds = "seq_id string, t int, bleeding string, mucus string, temp double, LH string, preg string, state int, tracking_category string, alpha double, alpha_level string, temp_sd double, mean_lE_sojourn double, sd_lE_sojourn double, mean_Lut_sojourn double, sd_Lut_sojourn double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        user = pdf.iloc[0]
        key = seed * 1_000_003 + int(user.number)
        days = simulate(model_of(user, stored(base.value)), user.seq_id, key, transitions)
        days["bleeding"] = days["bleeding"].where(days["bleeding"].notna(), "none")
        days = masked(days, user.tracking_category, np.random.default_rng(key + 1))
        for c in ("tracking_category", "alpha", "alpha_level", "temp_sd", "mean_lE_sojourn", "sd_lE_sojourn", "mean_Lut_sojourn", "sd_Lut_sojourn"):
            days[c] = user[c]
        return days[[x.split()[0] for x in kinds.split(", ")]]

    return dealt(spark.createDataFrame(users), "seq_id").groupBy("seq_id").applyInPandas(one, kinds)


def add_missing(df: DataFrame, channels: list[str], share: float, seed: int = 0, seq: str = "seq_id") -> DataFrame:
    """Blanks exactly round(share * rows) values of each channel in each sequence, in a fixed random order."""
    n = F.bround(share * F.count(F.lit(1)).over(Window.partitionBy(seq)))
    for k, c in enumerate(channels):
        order = F.row_number().over(Window.partitionBy(seq).orderBy(F.xxhash64(seq, "t", F.lit(seed), F.lit(k)), "t"))
        df = df.withColumn("__p", order).withColumn(c, F.when(F.col("__p") > n, F.col(c))).drop("__p")
    return df
