"""Forecasts of the next cycle's length and observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..hsmm.batch import Stack, by_length, coded, emissions, fit_each, stackable
from ..hsmm.batch import viterbi as viterbi_many
from ..hsmm.fit import fit
from ..hsmm.infer import anchored, viterbi
from ..hsmm.model import FLOOR, Model, stored
from .batched import at, column, on_sequences
from .cycles import MENSES, OVULATION
from .sequence import dealt, ordered, places, run_id, rising


def baseline_length(cycles: DataFrame, seq: str = "seq_id") -> DataFrame:
    """For each cycle: mean and deviation of the lengths of those before it, and their sum and number."""
    before = Window.partitionBy(seq).orderBy("cycle_number").rowsBetween(Window.unboundedPreceding, -1)
    added = {"predicted": F.avg("cycle_length"), "predicted_sd": F.stddev_samp("cycle_length"), "days_before": F.sum("cycle_length"), "cycles_before": F.count("cycle_length")}
    return cycles.withColumns({k: c.over(before) for k, c in added.items()})


def replay_baseline(days: DataFrame, channels: list[str], back: int = -18, seq: str = "seq_id", cycle: str = "cycle") -> DataFrame:
    """A forecast of each observation by the calendar: what was last reported on this day of the cycle.

    Days are counted from the end of a past cycle if they are near it, else from its start; the coming cycle is taken
    to have the mean length of the past ones, halves to even. Days beyond it take the last day's forecast.
    """
    df = places(days, [seq, cycle])
    past = Window.partitionBy(seq).orderBy(cycle).rangeBetween(Window.unboundedPreceding, -1)
    length = F.when(F.col("day_back") == -1, F.col("day"))  # on a cycle's last day
    df = df.withColumn("expected", F.bround(F.avg(length).over(past)).cast("int"))
    slot = F.when(F.col("day_back") >= back, F.col("day_back")).otherwise(F.col("day"))
    day = F.least("day", "expected")
    target = F.when(day - F.col("expected") - 1 >= back, day - F.col("expected") - 1).otherwise(day)
    # each day says what it knows and asks for its forecast; one pass in order of cycles carries values forward within (sequence, slot)
    none = [F.lit(None).cast(df.schema[c].dataType).alias(f"__{c}") for c in channels]
    says = F.struct(slot.alias("slot"), F.lit(1).alias("__after"), *[F.col(c).alias(f"__{c}") for c in channels])
    asks = F.when(F.col("expected").isNotNull(), F.struct(target.alias("slot"), F.lit(0).alias("__after"), *none))
    both = df.select(seq, cycle, "t", F.explode(F.array_compact(F.array(says, asks))).alias("x")).select(seq, cycle, "t", "x.*")
    by = Window.partitionBy(seq, "slot").orderBy(cycle, "__after").rowsBetween(Window.unboundedPreceding, -1)
    both = both.withColumns({f"forecast_{c}": F.last(f"__{c}", True).over(by) for c in channels})
    return both.filter("__after = 0").select(seq, cycle, "t", *[f"forecast_{c}" for c in channels])


def phase_table(decoded: DataFrame) -> DataFrame:
    """Most likely states (seq_id, t, state) with phase, day within it from both ends, and days since ovulation."""
    w = ordered("seq_id")
    df = decoded.withColumn("cycle", run_id(rising(F.col("state") == MENSES, w), "seq_id"))
    df = df.withColumn("ovulation_cycle", run_id(rising(F.col("state") == OVULATION, w), "seq_id"))
    since = F.col("t") - F.last(F.when(F.col("state") == OVULATION, F.col("t")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    start = F.last(F.when(rising(F.col("state") == MENSES, w), F.col("t")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumns({"since": since, "__start": start})
    luteal = (F.col("since") > 0) & (F.col("t") - F.col("since") >= F.col("__start"))
    df = df.withColumn("phase", F.when(F.coalesce(luteal, F.lit(False)), "luteal").otherwise("follicular"))
    return places(df.drop("__start"), ["seq_id", "cycle", "phase"])


def mean_phase_lengths(phases: DataFrame) -> DataFrame:
    """Mean length of each phase over a sequence's cycles, halves to even."""
    each = phases.filter("cycle > 0").groupBy("seq_id", "cycle", "phase").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("seq_id", "phase").agg(F.bround(F.avg("n")).cast("int").alias("phase_length"))


def aligned(phases: DataFrame) -> DataFrame:
    """Days of past cycles on the axis of the mean phase: the follicular phase by its end near ovulation, else by its start."""
    df = phases.filter("cycle > 0").join(mean_phase_lengths(phases), ["seq_id", "phase"])
    n, day, back = F.col("phase_length"), F.col("day"), F.col("day_back")
    follicular = F.when(back >= -3, n + back + 1).when(day <= n - 4, day)
    luteal = F.when(day <= 5, day).when(n + back + 1 > 5, n + back + 1)
    return df.withColumn("phase_day", F.when(F.col("phase") == "luteal", luteal).otherwise(follicular)).filter("phase_day is not null")


def observation_table(phases: DataFrame, observed: DataFrame, channels: list[str]) -> DataFrame:
    """By sequence, phase and aligned day: the most frequent report of each channel, and the share of days without one."""
    df = aligned(phases).join(observed.select("seq_id", "t", *channels), ["seq_id", "t"])
    keys = ["seq_id", "phase", "phase_day"]
    return df.groupBy(*keys).agg(*[F.mode(c, True).alias(c) for c in channels], *[F.avg(F.col(c).isNull().cast("double")).alias(f"p_missing_{c}") for c in channels])


TRAINING, SAMPLES, PERIOD_DAYS = 4, 100, 5


def training_stretches(panel: DataFrame, training: int = TRAINING, key: str = "seq_id", cycle: str = "cycle") -> DataFrame:
    """Days of stretches of ``training`` cycles and the one after them, all complete: adds first_cycle, nth (1 to training + 1).

    ``panel`` has a row a day with the number of its cycle, from 1. Stretches do not overlap. Cycle 0 and the last, which
    the end of the records cuts off, are in none.
    """
    last = F.max(cycle).over(Window.partitionBy(key))
    size = training + 1
    first = F.col(cycle) - F.pmod(F.col(cycle) - 1, F.lit(size))
    inside = panel.withColumn("__last", last).withColumns({"first_cycle": first, "nth": (F.pmod(F.col(cycle) - 1, F.lit(size)) + 1).cast("int")})
    return inside.filter((F.col(cycle) > 0) & (F.col("first_cycle") + training < F.col("__last"))).drop("__last")


def _taught(model: Model, days: pd.DataFrame, training: int) -> tuple[Model, pd.DataFrame, pd.DataFrame]:
    """The model fitted to a stretch's training days (which reach into the next period), these days, and those of the cycle to forecast."""
    days = days.sort_values("t").drop_duplicates("t").reset_index(drop=True)
    target = days[days["nth"] == training + 1].reset_index(drop=True)
    known = days[(days["nth"] <= training) | (days["t"] < target["t"].min() + PERIOD_DAYS)].reset_index(drop=True)
    return fit(model, known.assign(seq_id=0), weight_emission=10).model, known, target


def _anchored_path(model: Model, days: pd.DataFrame) -> np.ndarray:
    """Most likely states of a cycle's days so far; its first day is menses for sure."""
    sure = pd.DataFrame({"t": [days["t"].iloc[0]], "state": [MENSES]})
    return viterbi(model, anchored(model.emissions(days), days["t"].to_numpy(), sure, 1.0))[0]


def cycle_length_samples(model: Model, days: pd.DataFrame, n: int = SAMPLES, seed: int = 0) -> np.ndarray:
    """Lengths of the current cycle, sampled from its records so far."""
    return _sampled(model, _anchored_path(model, days), n, seed)


def _sampled(model: Model, path: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Lengths of a cycle with this most likely path so far.

    From the day on which the state that was entered last begins, the sojourns of it and of all states after it in the
    order of the model are drawn, whatever part of the first has passed.
    """
    rng = np.random.default_rng(seed)
    states, entered = np.unique(path, return_index=True)
    at = int(entered.argmax())
    length = np.full(n, float(entered[at]))
    for s in range(int(states[at]) - 1, model.J):
        length += rng.choice(np.arange(1, len(model.sojourn) + 1), n, p=model.sojourn[:, s] / model.sojourn[:, s].sum())
    return length


def _taught_batch(table: pa.Table, edges: np.ndarray, model: Model, training: int):
    """``_taught`` of a batch: for stretches of which as many days are known, their models, and the rows where their known days begin, the last cycle begins, and it ends; and a function for most likely paths so far of the last cycles."""
    nth, t = (column(table, c).to_numpy() for c in ("nth", "t"))
    reports = coded(model, {c: column(table, c) for c in model.emission if c in table.column_names})
    lows, ends = edges[:-1], edges[1:]
    target = np.array([lo + int(np.searchsorted(nth[lo:hi], training + 1)) for lo, hi in zip(lows, ends)])
    known = np.array([hi if at == hi else lo + int(np.searchsorted(t[lo:hi], t[at] + PERIOD_DAYS)) for lo, at, hi in zip(lows, target, ends)])
    sure = np.full(model.J, FLOOR)
    sure[MENSES - 1] = 0

    def paths(x: Stack, starts: np.ndarray, n: int | None, anchor: bool = True) -> np.ndarray:
        """Of the first n days, or of all that are known."""
        rows = starts[:, None] + np.arange(n or known[np.searchsorted(lows, starts[0])] - starts[0])
        n = rows.shape[1]
        x = x.reach(n, model)
        logb = emissions(x, {k: v[rows] for k, v in reports.items()}, rows.shape)
        if anchor:
            logb[:, 0] = np.maximum(logb[:, 0] + sure, FLOOR)
        return viterbi_many(x, logb)

    for which, rows in by_length(lows, known, model.J):
        own, _, _ = fit_each(model, {k: v[rows] for k, v in reports.items()}, rows.shape, weight_emission=10)
        yield own, lows[which], target[which], ends[which], paths


def _days_so_far(own: Stack, target: np.ndarray, ends: np.ndarray, paths, less: int = 0):
    """Days of last cycles, from 1, with the number of the stretch and the path up to ``less`` days before."""
    for day in range(1, int((ends - target).max(initial=0)) + 1):
        which = np.flatnonzero(ends - target >= day)
        found = paths(own.take(which), target[which], day - less) if day > less else np.zeros((len(which), 0), int)
        for k, path in zip(which.tolist(), found):
            yield day, k, path


def _by_stretch(stretches: DataFrame, model: Model, key: str, one, many, columns: str) -> DataFrame:
    """Rows for each stretch, its key and first cycle before them: ``many`` (table, edges, model) gives them for a batch of
    stretches, ``one`` (days, model) for a single one, if the model can only be fitted to one at a time."""
    channels = [c for c in model.emission if c in stretches.columns]
    text, kind = stretches.sparkSession.sparkContext.broadcast(model.to_json()), stretches.schema[key].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = one(pdf, stored(text.value))
        got.insert(0, key, pdf[key].iloc[0])
        got.insert(1, "first_cycle", pdf["first_cycle"].iloc[0])
        return got

    days = stretches.select(key, F.col("first_cycle").cast("long").alias("first_cycle"), "nth", F.col("t").cast("int").alias("t"), *channels)
    schema = f"{key} {kind}, first_cycle long, {columns}"
    if not stackable(model):
        return dealt(days, key).groupBy(key, "first_cycle").applyInPandas(run, schema)

    def batch(table: pa.Table, edges: np.ndarray):
        for stretch, rest in many(table, edges, stored(text.value)):
            own = {c: at(column(table, c), stretch) for c in (key, "first_cycle")} | rest
            yield pa.RecordBatch.from_arrays(list(own.values()), list(own))

    return on_sequences(days, [key, "first_cycle"], batch, schema)


def predict_lengths(stretches: DataFrame, model: Model, training: int = TRAINING, key: str = "seq_id", n: int = SAMPLES) -> DataFrame:
    """For each stretch and each day of its last cycle: the predicted length, its deviation, the true length and the difference.

    ``stretches`` comes from ``training_stretches``. The model is fitted to the training cycles of each stretch, and the
    last cycle is decoded anew up to each day.
    """

    def one(pdf: pd.DataFrame, given: Model) -> pd.DataFrame:
        own, _, target = _taught(given, pdf, training)
        rows = []
        for day in range(1, len(target) + 1):
            x = cycle_length_samples(own, target.iloc[:day], n, day)
            rows.append((day, float(x.mean()), float(x.std(ddof=1)), len(target), float(x.mean()) - len(target)))
        return pd.DataFrame(rows, columns=["cycleday", "predicted", "predicted_sd", "cycle_length", "difference"])

    def many(table: pa.Table, edges: np.ndarray, given: Model):
        for own, low, target, ends, paths in _taught_batch(table, edges, given, training):
            models, rows = [own.model(k, given) for k in range(len(low))], []
            for day, k, path in _days_so_far(own, target, ends, paths):
                x, length = _sampled(models[k], path, n, day), int(ends[k] - target[k])
                rows.append((low[k], day, float(x.mean()), float(x.std(ddof=1)), length, float(x.mean()) - length))
            stretch, *values = zip(*rows) if rows else [()] * 6
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64())
            yield np.array(stretch, int), {name: pa.array(v, kind) for name, v, kind in zip(("cycleday", "predicted", "predicted_sd", "cycle_length", "difference"), values, kinds)}

    return _by_stretch(stretches, model, key, one, many, "cycleday int, predicted double, predicted_sd double, cycle_length int, difference double")


def phase_days(path: np.ndarray, training: int = TRAINING) -> pd.DataFrame:
    """``place`` in the path, phase, phase_day of the days of the first cycles, on the axis of the mean phase (see ``aligned``)."""
    place, luteal, day = _phases(path, training)
    return pd.DataFrame({"place": place, "phase": np.where(luteal, "luteal", "follicular"), "phase_day": day})


def _phases(path: np.ndarray, training: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place, ovulation = np.arange(len(path)), path == OVULATION
    cycle, ovulations = ((path == MENSES) & (np.append(0, path[:-1]) != MENSES)).cumsum(), ovulation.cumsum()

    def at(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.bincount(by)
        return place - (np.cumsum(size) - size)[by], size[by]

    (day, length), (since, span) = at(cycle), at(ovulations)
    luteal = (cycle == ovulations) & (since > 0)
    by_start = np.where(luteal, day - length, day + 1)
    by_ovulation = np.where(luteal | ovulation, since, since - span)
    inside, n = (cycle >= 1) & (cycle <= training), np.zeros(len(path))
    for phase in (luteal, ~luteal):
        sizes = np.bincount(cycle[inside & phase])
        n[phase] = np.round(sizes[sizes > 0].mean()) if sizes.any() else np.nan
    in_follicular = np.where(by_ovulation >= -3, n + by_ovulation, np.where(by_start <= n - 4, by_start, np.nan))
    in_luteal = np.where(by_ovulation <= 5, by_ovulation, np.where(by_start >= 5 - n, n + by_start + 1, np.nan))
    phase_day = np.where(luteal, in_luteal, in_follicular)
    known = inside & ~np.isnan(phase_day)
    return place[known], luteal[known], phase_day[known]


def predict_observations(stretches: DataFrame, model: Model, training: int = TRAINING, key: str = "seq_id") -> DataFrame:
    """For each day of a stretch's last cycle, what was reported on the aligned days of the training cycles: a row for each of these.

    The day before is decoded first: after an ovulation the coming day is as many luteal days on as states after it, else
    its day of the cycle; a day beyond the table's last is taken as that one.
    """
    channels = [c for c in model.emission if c in stretches.columns]

    def one(pdf: pd.DataFrame, given: Model) -> pd.DataFrame:
        own, known, target = _taught(given, pdf, training)
        table = phase_days(viterbi(own, own.emissions(known))[0], training).merge(known[channels].rename_axis("place").reset_index(), on="place")
        out = []
        for day in range(1, len(target) + 1):
            path = _anchored_path(own, target.iloc[: day - 1]) if day > 1 else np.zeros(0, int)
            phase, goal = ("luteal", int((path > OVULATION).sum()) + 1) if (path == OVULATION).any() else ("follicular", day)
            of = table[table["phase"] == phase]
            of = of[of["phase_day"] == min(goal, of["phase_day"].max())] if len(of) else of
            out.append(of.drop(columns="place").assign(t=int(target["t"].iloc[day - 1]), cycleday=day))
        got = pd.concat(out)
        return got.assign(phase_day=got["phase_day"].astype(int))[["t", "cycleday", "phase", "phase_day", *channels]]

    def many(table: pa.Table, edges: np.ndarray, given: Model):
        t = column(table, "t").to_numpy()
        for own, low, target, ends, paths in _taught_batch(table, edges, given, training):
            tables, rows = [_phases(path, training) for path in paths(own, low, None, False)], []
            for day, k, path in _days_so_far(own, target, ends, paths, 1):
                after = bool((path == OVULATION).any())
                place, luteal, phase_day = tables[k]
                of = np.flatnonzero(luteal == after)
                if len(of):
                    goal = int((path > OVULATION).sum()) + 1 if after else day
                    of = of[phase_day[of] == min(goal, phase_day[of].max())]
                rows += [(low[k], low[k] + place[j], target[k] + day - 1, day, after, int(phase_day[j])) for j in of]
            stretch, source, now, day, after, phase_day = np.array(rows, int).reshape(-1, 6).T
            phase = pa.array(np.where(after == 1, "luteal", "follicular").tolist(), pa.string())
            yield stretch, {"t": pa.array(t[now]), "cycleday": pa.array(day.astype(np.int32)), "phase": phase, "phase_day": pa.array(phase_day.astype(np.int32))} | {c: at(column(table, c), source) for c in channels}

    kinds = ", ".join(f"{c} {stretches.schema[c].dataType.simpleString()}" for c in channels)
    return _by_stretch(stretches, model, key, one, many, f"t int, cycleday int, phase string, phase_day int, {kinds}")
