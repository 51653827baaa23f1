"""Hierarchical decoding of whole panels.

A sequence is first decoded by bleeding alone, which gives cycles and sure
anchors. Cycles that are tracked alike form stretches; each stretch is decoded
with a model adjusted to what is tracked in it, neighbouring stretches overlap
by a period, and their results are stitched. Nothing needs another sequence, so
a panel is dealt by sequence once and decoded in batches of whole sequences
(``decode_batch``), in which all stretches of one length go together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..hsmm.batch import Stack, by_length, coded, emissions, fit_each, stackable
from ..hsmm.batch import expected as expected_many
from ..hsmm.batch import forward_backward as forward_backward_many
from ..hsmm.fit import Counts, Fit, expected, fit, iterate, merged
from ..hsmm.infer import anchored, decode, forward_backward, viterbi
from ..hsmm.joint import JointModel
from ..hsmm.model import Model, log, stored
from . import decode_batch
from .batched import at, column, lists, on_sequences, whole_sequences
from .sequence import dealt

CHANNELS = ["bleeding", "mucus", "temp", "LH", "preg"]
SURE = 0.75


@dataclass
class Limits:
    """Days by cycle that make a class of tracking."""

    mucus: int = 5
    temp: int = 8


def bleeding_cycles(days: pd.DataFrame, bleeding: Model) -> pd.DataFrame:
    """t, state, prob, menses, cycle from the bleeding model alone."""
    out = decode(bleeding, days[["t", "bleeding"]])
    out["menses"] = (out["state"] == bleeding.state("M")) & (out["prob"] > SURE)
    out["cycle"] = (out["menses"] & ~out["menses"].shift(fill_value=False)).cumsum()
    return out


def anchors(cycles: pd.DataFrame, model: Model) -> pd.DataFrame:
    """Sure days of menses and birth."""
    sure = cycles[cycles["state"].isin([model.state("M"), model.state("B")]) & (cycles["prob"] > SURE)] if "B" in model.names else cycles[cycles["menses"]]
    return sure[["t", "state"]].assign(trust=SURE)


def behavior(group: pd.DataFrame, limits: Limits) -> str:
    n = max(group["cycle"].nunique(), 1)
    count = {c: int(group[c].notna().sum()) if c in group else 0 for c in CHANNELS}
    mucus, temp = count["mucus"] >= limits.mucus * n, count["temp"] >= limits.temp * n
    if mucus or temp:
        return "B" + "T" * temp + "M" * mucus
    return "BLH" if count["LH"] >= n else "BP" if count["preg"] >= n else "B"


def stretches(days: pd.DataFrame, limits: Limits) -> pd.DataFrame:
    """Stretches of cycles of one class: start, end, behavior; each ends with the next one's first period."""
    rows = []
    for cycle, g in days.groupby("cycle", sort=True):
        period = int((~g["menses"]).to_numpy().argmax()) if not g["menses"].all() else len(g)
        rows.append((cycle, behavior(g, limits), g["t"].min(), g["t"].max(), period))
    merged: list[list] = []
    for _, kind, low, high, period in rows:
        if merged and merged[-1][0] == kind:
            merged[-1][2] = high
        else:
            merged.append([kind, low, high, period])
    for before, after in zip(merged, merged[1:]):
        before[2] += after[3]
    got = pd.DataFrame([(k + 1, kind, low, high) for k, (kind, low, high, _) in enumerate(merged)], columns=["stretch_number", "tracking_behavior", "start", "end"])
    return got[got["end"] > got["start"]].reset_index(drop=True)


def adjust(model: Model, kind: str, days: pd.DataFrame, fixed_sojourns: bool = True) -> Model:
    """The model for a stretch tracked as ``kind``: only what is observed, with the stretch's own frequencies of reports."""
    model = model.without([k for k in model.emission if k not in days or not days[k].notna().any()])
    at = {n: model.names.index(n) for n in model.names}
    d, step = model.sojourn.copy(), model.transition.copy()

    def lasting(name: str, n: int) -> None:
        if name in at and n <= len(d):
            d[:, at[name]] = 0
            d[n - 1, at[name]] = 1

    if fixed_sojourns and kind in ("B", "BP"):
        lasting("Lut", 11)
    if fixed_sojourns and kind in ("B", "BP", "BLH", "BT"):
        lasting("hE", 3)
    frequency = {k: float(days[k].notna().mean()) for k in model.emission}
    if "hE" in at and "lE" in at:
        hE, lE = at["hE"], at["lE"]
        if frequency.get("mucus", 0) > 0:
            step[hE, lE] *= frequency["mucus"]
        # a few reports of mucus do not make a class: without one, going back is set whatever they are
        if kind == "BP":
            step[hE, lE] = 0.001
        if kind == "B":
            step[hE, lE] = 0
    if "Ano" in at and kind not in ("BTM", "BT"):
        step[:, at["Ano"]] = 0
    lost = step.sum(axis=1) == 0
    step[lost] = model.transition[lost]
    step /= step.sum(axis=1, keepdims=True)

    p = np.full(model.J, 1 - float(days[list(model.emission)].notna().any(axis=1).mean()) if model.emission else 0.0)
    q = {k: np.full(model.J, 1 - f) for k, f in frequency.items()}

    def put(values: np.ndarray, names: str, value: float) -> None:
        for n in names.split():
            if n in at:
                values[at[n]] = value

    base = p[0]
    put(p, "M", min(0.2, 0.4 * base))
    put(p, "Ano L", min(0.3, 0.7 * base))
    put(p, "AB", 0.2)
    if "bleeding" in q:
        q["bleeding"][:] = 0
    if "preg" in q:
        base = q["preg"][0]
        put(q["preg"], "P", base * 0.5)
        put(q["preg"], "Lut PB1 PL", base * 0.8)
    if "temp" in q:
        base = q["temp"][0]
        put(q["temp"], "P", base * 0.8)
        put(q["temp"], "Ano", base * 0.5)
    return replace(model, transition=step, sojourn=d, p=p, q=q)


def decode_stretch(days: pd.DataFrame, kind: str, model: Model, truth: pd.DataFrame, fitted: bool = False, fixed_sojourns: bool = True) -> pd.DataFrame:
    """All states of all days with their posteriors, and whether they are on the most likely path."""
    own = adjust(model, kind, days, fixed_sojourns)
    truth = truth[truth["t"].isin(days["t"])]
    if fitted:
        own = fit(own, days.assign(seq_id=0), truth.assign(seq_id=0) if len(truth) else None, lock_transition=True, weight_emission=100, most=10).model
    logb = anchored(own.emissions(days), days["t"].to_numpy(), truth)
    path, _ = viterbi(own, logb)
    gamma = forward_backward(own, logb).gamma
    J = own.J
    return pd.DataFrame({"t": np.repeat(days["t"].to_numpy(), J), "state": np.tile(np.arange(1, J + 1), len(days)), "prob": gamma.ravel(), "on_path": (path[:, None] == np.arange(1, J + 1)).ravel()})


def stitch(parts: pd.DataFrame, menses: int = 1) -> tuple[pd.DataFrame, list[tuple[float, float, float]]]:
    """Decoded stretches to one row a day, and the seams (number, first and last day) where a stretch knows no menses.

    Where stretches overlap, probabilities are averaged and the best state is taken; the stretch's number is the mean of
    those that meet. ``stitching`` has the same for whole panels.
    """
    numbers = parts[parts["on_path"]].groupby("t")["stretch_number"].agg(["nunique", "mean"])
    meet = numbers.loc[numbers["nunique"] > 1, "mean"]
    both, fix = parts[parts["t"].isin(meet.index) & parts["on_path"]], []
    for number, days in meet.groupby(meet):
        here = both[both["t"].isin(days.index)]
        if not (here["state"] == menses).groupby(here["stretch_number"]).any().all():
            fix.append((float(number), days.index.min(), days.index.max()))
    mean = parts.groupby(["t", "state"], as_index=False).agg(prob=("prob", "mean"), on_path=("on_path", "max"), stretch_number=("stretch_number", "mean"), tracking_behavior=("tracking_behavior", lambda s: "-".join(dict.fromkeys(s))))
    mean.loc[mean["t"].isin(meet.index), "on_path"] = False
    best = mean[mean["t"].isin(meet.index)].sort_values(["t", "prob", "state"], ascending=[True, False, True]).drop_duplicates("t").index
    mean.loc[best, "on_path"] = True
    return mean[mean["on_path"]].drop(columns="on_path").sort_values("t").reset_index(drop=True), fix


def decode_user(days: pd.DataFrame, model: Model, bleeding: Model, adaptive: bool = True, fitted: bool = False, limits: Limits = Limits(), fixed_sojourns: bool = True) -> pd.DataFrame:
    """One sequence (t, channels) -> t, state, prob, stretch_number, tracking_behavior."""
    days = days.sort_values("t").drop_duplicates("t").reset_index(drop=True)
    if not adaptive:
        own = model.without([k for k in model.emission if k not in days])
        if fitted:
            own = fit(own, days.assign(seq_id=0), lock_transition=True, weight_emission=100, most=10).model
        return decode(own, days).assign(stretch_number=1.0, tracking_behavior="")
    cycles = bleeding_cycles(days, bleeding)
    truth = anchors(cycles, model)
    marked = days.merge(cycles[["t", "cycle", "menses"]], on="t")
    spans = stretches(marked, limits)
    if not len(spans):
        spans = pd.DataFrame([(1, behavior(marked, limits), days["t"].min(), days["t"].max())], columns=["stretch_number", "tracking_behavior", "start", "end"])

    def run(low: float, high: float, kind: str, number: float, truth: pd.DataFrame) -> pd.DataFrame:
        part = days[days["t"].between(low, high)]
        return decode_stretch(part, kind, model, truth, fitted, fixed_sojourns).assign(stretch_number=number, tracking_behavior=kind)

    parts = [run(s.start, s.end, s.tracking_behavior, float(s.stretch_number), truth) for s in spans.itertuples()]
    out, fix = stitch(pd.concat(parts, ignore_index=True), model.state("M"))
    if fix:  # decode again from the cycle before a broken seam to the start after it, anchored at sure cycle starts
        menses = model.state("M")
        starts = out.loc[(out["state"] == menses) & (out["state"].shift() != menses) & (out["prob"] > SURE), "t"].to_numpy()
        spans, redo = [], []
        for number, low, high in fix:
            before, after = starts[starts < low], starts[starts > high]
            spans.append([before.max() if len(before) else days["t"].min(), min(after.min() + 5, days["t"].max()) if len(after) else days["t"].max(), number])
        for span in sorted(spans):
            if redo and span[0] <= redo[-1][1]:
                redo[-1][1:] = max(redo[-1][1], span[1]), min(redo[-1][2], span[2])
            else:
                redo.append(span)
        for low, high, number in redo:
            sure = pd.DataFrame({"t": [t for t in starts if t in (low, high - 5)], "state": menses, "trust": 1.0})
            inside = marked[marked["t"].between(low, high)]
            fresh = run(low, high, behavior(inside, limits), number, sure)
            fresh = fresh[fresh["on_path"]].drop(columns="on_path")
            out = pd.concat([out[~out["t"].between(low, high)], fresh[out.columns]]).sort_values("t").reset_index(drop=True)
    return out


DECODED = "seq_id {key}, t int, state int, prob double, stretch_number double, tracking_behavior string"


def decode_panel(panel: DataFrame, model: Model, bleeding: Model, key: str = "seq_id", adaptive: bool = True, fitted: bool = False, limits: Limits = Limits(), fixed_sojourns: bool = True) -> DataFrame:
    """All sequences of a dense panel (key, t, channels), in batches (``decode_batch``); fitted models one sequence at a time."""
    channels = [c for c in CHANNELS if c in panel.columns]
    kind = panel.schema[key].dataType.simpleString()
    a, b = panel.sparkSession.sparkContext.broadcast(model.to_json()), panel.sparkSession.sparkContext.broadcast(bleeding.to_json())
    days, schema = panel.select(key, F.col("t").cast("int").alias("t"), *channels), DECODED.format(key=kind)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = decode_user(pdf, stored(a.value), stored(b.value), adaptive, fitted, limits, fixed_sojourns)
        got.insert(0, "seq_id", pdf[key].iloc[0])
        return got[["seq_id", "t", "state", "prob", "stretch_number", "tracking_behavior"]]

    def many(table: pa.Table, edges: np.ndarray):
        given = stored(a.value)
        if adaptive:
            rows, *got = decode_batch.hierarchical(table, edges, given, stored(b.value), limits, channels, SURE, fixed_sojourns)
        else:
            own = given.without([k for k in given.emission if k not in channels])
            rows = np.arange(len(table))
            got = [*decode_batch.decoded(own, coded(own, {c: column(table, c) for c in channels}), edges), np.ones(len(table)), np.full(len(table), "", object)]
        state, prob, number, behavior = got
        yield pa.RecordBatch.from_arrays([at(column(table, key), rows), at(column(table, "t"), rows), pa.array(state.astype(np.int32)), pa.array(prob), pa.array(number), pa.array(behavior, pa.string())], ["seq_id", "t", "state", "prob", "stretch_number", "tracking_behavior"])

    if fitted:
        return dealt(days, key).groupBy(key).applyInPandas(one, schema)
    return on_sequences(days, [key], many, schema)


def posterior_panel(panel: DataFrame, model: Model, key: str = "seq_id") -> DataFrame:
    """Posteriors of all states on all days by one model."""
    channels = [c for c in model.emission if c in panel.columns]
    text = panel.sparkSession.sparkContext.broadcast(model.to_json())
    kind = panel.schema[key].dataType.simpleString()

    def many(table: pa.Table, edges: np.ndarray):
        given = stored(text.value)
        reports = coded(given, {c: column(table, c) for c in channels})
        for _, rows in by_length(edges[:-1], edges[1:], given.J):
            x = Stack.of(given, rows.shape[1])
            gamma = forward_backward_many(x, emissions(x, {k: v[rows] for k, v in reports.items()}, rows.shape)).gamma
            rows = rows.ravel()
            yield pa.RecordBatch.from_arrays([at(column(table, key), rows), at(column(table, "t"), rows), lists(gamma.reshape(len(rows), -1))], ["seq_id", "t", "probs"])

    got = on_sequences(panel.select(key, F.col("t").cast("int").alias("t"), *channels), [key], many, f"seq_id {kind}, t int, probs array<double>")
    return got.select("seq_id", "t", F.posexplode("probs").alias("place", "prob")).select("seq_id", "t", (F.col("place") + 1).alias("state"), "prob")


def fit_panel(panel: DataFrame, model: Model, key: str = "seq_id", models: bool = True, **how) -> DataFrame:
    """A model for each sequence: seq_id, model (JSON, if ``models``), loglik by iteration, message.

    Sequences of one length are fitted at once; models whose sojourns have a form, one at a time.
    """
    channels = [c for c in model.emission if c in panel.columns]
    text = panel.sparkSession.sparkContext.broadcast(model.to_json())
    kind = panel.schema[key].dataType.simpleString()
    days, schema = panel.select(key, "t", *channels), f"seq_id {kind}, {'model string, ' * models}loglik array<double>, message string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = fit(stored(text.value), pdf.rename(columns={key: "seq_id"}), **how)
        return pd.DataFrame({"seq_id": [pdf[key].iloc[0]]} | ({"model": [got.model.to_json()]} if models else {}) | {"loglik": [got.loglik], "message": [got.message]})

    def many(table: pa.Table, edges: np.ndarray):
        given = stored(text.value)
        reports = coded(given, {c: column(table, c) for c in channels})
        for _, rows in by_length(edges[:-1], edges[1:], given.J):
            got, lls, messages = fit_each(given, {k: v[rows] for k, v in reports.items()}, rows.shape, **how)
            own = {"model": pa.array([got.model(k, given).to_json() for k in range(len(rows))], pa.string())} if models else {}
            columns = {"seq_id": at(column(table, key), rows[:, 0])} | own | {"loglik": pa.array(lls, pa.list_(pa.float64())), "message": pa.array(messages, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    if not stackable(model):
        return dealt(days, key).groupBy(key).applyInPandas(one, schema)
    return on_sequences(days, [key], many, schema, once=False)


def simulate_panel(spark, model: Model, n: int, transitions: int = 100, seed: int = 0) -> DataFrame:
    """n sequences drawn from the model, each from a seed of its own."""
    from ..hsmm.simulate import simulate

    text = spark.sparkContext.broadcast(model.to_json())

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["id"].iloc[0])
        return simulate(stored(text.value), f"S{k}", seed * 1_000_003 + k, transitions)

    channels = ", ".join(f"{k} {'string' if hasattr(f, 'values') else 'double'}" for k, f in model.emission.items())
    return dealt(spark.range(n).toDF("id"), "id").groupBy("id").applyInPandas(one, f"seq_id string, t int, {channels}, state int")


def fit_jointly(panel: DataFrame, model: Model, truth: DataFrame | None = None, trust: float = 1.0, key: str = "seq_id", **how) -> Fit:
    """One model for all sequences, by rounds in which each task adds up the expected counts of its sequences.

    The panel is dealt and sorted by sequence once and held for the rounds; a lost part is made again from its source. A
    round sends the model to the tasks, and each sends back its counts that are not zero, which Spark adds up; so what
    comes to the driver has the size of the model, and a task holds one sequence at a time. ``truth`` (key, t, state)
    has labels of days. Rows without a sequence are left out; of rows of one day any one is taken.
    """
    spark = panel.sparkSession
    channels = [c for c in model.emission if c in panel.columns]
    days = panel.filter(F.col(key).isNotNull()).select(F.col(key).alias("seq_id"), "t", *channels)
    if truth is not None:
        days = days.join(truth.select(F.col(key).alias("seq_id"), "t", F.col("state").alias("__truth")), ["seq_id", "t"], "left")
    days = dealt(days, "seq_id").sortWithinPartitions("seq_id", "t").persist()

    moves = not how.get("lock_transition", False)

    def count(now: Model) -> Counts:
        sent = spark.sparkContext.broadcast(now)
        if isinstance(now, JointModel):
            rows = days.mapInPandas(lambda frames: _counts(frames, sent.value, trust), "name string, place int, value double")
        else:
            rows = days.mapInArrow(lambda batches: _sums(batches, sent.value, trust, moves), "name string, place int, value double")
        sums = rows.groupBy("name", "place").agg(F.sum("value").alias("value")).toArrow().to_pydict()
        shapes = expected(now, pd.DataFrame({"t": [1], **{c: pd.Series([None], dtype=object) for c in channels}}))
        total = {k: np.zeros(v.size) for k, v in shapes.items()}
        for name, place, value in zip(sums["name"], sums["place"], sums["value"], strict=True):
            total[name][place] = value
        sent.unpersist()
        return {k: v.reshape(shapes[k].shape) for k, v in total.items()}

    try:
        return iterate(model, count, **how)
    finally:
        days.unpersist()


def _sequences(frames):
    """The sequences of sorted rows, one at a time."""
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        ids = pdf["seq_id"].to_numpy()
        edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for lo, hi in zip(edges, edges[1:]):
            if held and held[0]["seq_id"].iloc[0] != ids[lo]:
                yield pd.concat(held)
                held = []
            held.append(pdf.iloc[lo:hi])
    if held:
        yield pd.concat(held)


def _counts(frames, model: Model, trust: float):
    total: Counts = {}
    for days in _sequences(frames):
        days = days.drop_duplicates("t").reset_index(drop=True)
        labels = days.loc[days["__truth"].notna(), ["t", "__truth"]].rename(columns={"__truth": "state"}) if "__truth" in days else None
        total = merged(total, expected(model, days, labels, trust))
    for name, value in total.items():
        flat = value.ravel()
        at = np.flatnonzero(flat)
        yield pd.DataFrame({"name": name, "place": at.astype(np.int32), "value": flat[at]})


def _sums(batches, model: Model, trust: float, moves: bool):
    """The counts of a task's sequences, by batches of one length; rows of a day are taken once."""
    total: Counts = {}
    labels = np.zeros((model.J + 1, model.J))
    labels[1:] = log(np.full((model.J, model.J), (1 - trust) / model.J) + trust * np.eye(model.J))
    for table, edges in whole_sequences(batches, ["seq_id"]):
        reports = coded(model, {c: column(table, c) for c in model.emission if c in table.column_names})
        truth = column(table, "__truth").fill_null(0).to_numpy(zero_copy_only=False).astype(int) if "__truth" in table.column_names else None
        for _, rows in by_length(edges[:-1], edges[1:], model.J):
            x = Stack.of(model, rows.shape[1])
            got = {k: v.sum(axis=0) for k, v in expected_many(x, {k: v[rows] for k, v in reports.items()}, rows.shape, moves, None if truth is None else labels[truth[rows]]).items()}
            head, rest = got.pop("head"), got.pop("rest")
            later = model.sojourn[len(head) :]
            longer = later * (rest / np.maximum(later.sum(axis=0), 1e-300))
            total = merged(total, got | {"loglik": np.atleast_1d(got["loglik"]), "durations": np.vstack((head, longer))})
    for name, value in total.items():
        flat = value.ravel()
        place = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(place), pa.string()), pa.array(place.astype(np.int32)), pa.array(flat[place])], ["name", "place", "value"])


def four_decodings(panel: DataFrame, model: Model, key: str = "seq_id", jointly: bool = False, **how) -> DataFrame:
    """States by Viterbi and by posterior, of the given and of the fitted model, side by side for each day.

    The model is fitted to each sequence, or ``jointly`` to all of them (``fit_jointly``).
    """
    channels = [c for c in model.emission if c in panel.columns]
    fitted = fit_jointly(panel, model, key=key, **how).model if jointly else None
    sent, kind = panel.sparkSession.sparkContext.broadcast((model, fitted)), panel.schema[key].dataType.simpleString()
    names = ["viterbi_specified", "smoothed_specified", "viterbi_fitted", "smoothed_fitted"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        given, together = sent.value
        days, states = pdf.sort_values("t").drop_duplicates("t"), []
        for m in (given, together or fit(given, days.rename(columns={key: "seq_id"}), **how).model):
            logb = m.emissions(days)
            states += [viterbi(m, logb)[0], forward_backward(m, logb).gamma.argmax(axis=1) + 1]
        return pd.DataFrame({"seq_id": days[key].to_numpy(), "t": days["t"].to_numpy(), **dict(zip(names, states))})

    return dealt(panel.select(key, "t", *channels), key).groupBy(key).applyInPandas(one, f"seq_id {kind}, t int, " + ", ".join(f"{n} int" for n in names))
