"""Domain operators on small tables whose results are worked out by hand."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rivulet.functions import columns as X
from rivulet.hsmm.cycle_model import bleeding_model, cycle_model, dedicated
from rivulet.hsmm.simulate import simulate
from rivulet.operators import cycles, decode, evaluate, features, observe, predict, sequence, tables, tracking, users
from rivulet.operators.rolling import frame, roll
from rivulet.sources import io

from . import plain_rules


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_columns(spark):
    df = spark.createDataFrame([(1, -2.0, "b"), (2, None, None), (3, 9.0, "zz")], "k int, x double, s string")
    got = df.select(
        "k", X.clamp("x", -1, 1).alias("c"), X.parallel_max("x", 0.0).alias("m"), X.if_else(F.col("x") > 0, F.lit("y"), F.lit("n")).alias("i"), X.lookup("s", {"b": 5}, 0).alias("l"),
        X.by_position("k", ["one", "two"]).alias("p"), X.level("s", ["a", "b"]).alias("v"), X.sentence(F.lit("hELLO")).alias("t"), X.to_step(F.lit(0.5), 1.0).alias("r"), X.cut("x", [-5, 0, 9], ["lo", "hi"]).alias("b"),
    )
    assert rows(got, "k") == [(1, -1.0, 0.0, "n", 5, "one", 2, "Hello", 0.0, "lo"), (2, None, None, None, 0, "two", None, "Hello", 0.0, None), (3, 1.0, 9.0, "y", 0, None, None, "Hello", 0.0, "hi")]
    agg = df.agg(X.strict(F.sum("x"), "x").alias("s"), X.distinct_with_missing("s").alias("d"), X.weighted_mean("x", "k").alias("w"))
    assert rows(agg) == [(None, 3, (-2 + 27) / 4)]


def test_densify_and_islands(spark):
    d = lambda n: dt.date(2024, 1, n)
    df = spark.createDataFrame([("a", d(1), 1), ("a", d(4), None), ("a", d(4), 2), ("b", d(9), 3)], "seq_id string, d date, x int")
    got = sequence.relative_day(sequence.densify(df))
    assert rows(got.select("seq_id", "t", "x"), "seq_id", "t") == [("a", 1, 1), ("a", 2, None), ("a", 3, None), ("a", 4, None), ("b", 1, 3)]
    locf = got.withColumn("l", sequence.locf("x", "seq_id"))
    again = locf.withColumn("m", sequence.locf("l", "seq_id"))
    assert again.filter("not (l <=> m)").count() == 0
    gaps = sequence.gap_runs(got, F.col("x").isNull(), 3).select("seq_id", "t", "gap_id", "gap_length", "gap")
    assert rows(gaps.filter("gap_id is not null"), "t") == [("a", 2, 1, 3, True), ("a", 3, 1, 3, True), ("a", 4, 1, 3, True)]
    ones = spark.createDataFrame([("a", t, v) for t, v in enumerate([None, None, 1, 1, 2, None], 1)] + [("b", 1, None)], "seq_id string, t int, v int")
    assert rows(sequence.runs(ones, "v"), "seq_id", "run") == [("a", 1, None, 1, 2, 2), ("a", 2, 1, 3, 4, 2), ("a", 3, 2, 5, 5, 1), ("a", 4, None, 6, 6, 1), ("b", 1, None, 1, 1, 1)]


def test_rolling(spark):
    assert frame(7) == (-6, 0) and frame(5, "center") == (-2, 2) and frame(4, "left") == (0, 3)
    df = spark.createDataFrame([("a", t, float(v) if v is not None else None) for t, v in enumerate([1, None, 3, 4], 1)], "seq_id string, t int, x double")
    w = sequence.ordered("seq_id")
    got = df.select("t", roll("x", F.sum, 2, w).alias("r"), roll("x", F.sum, 9, w, fill=0.0).alias("f"), roll("x", F.sum, 3, w, "center").alias("c"), roll("x", F.sum, 2, w, full=False).alias("p"))
    assert rows(got, "t") == [(1, None, 0.0, None, 1.0), (2, 1.0, 0.0, 4.0, 1.0), (3, 3.0, 0.0, 7.0, 3.0), (4, 7.0, 0.0, None, 7.0)]


def test_neighbours_and_spans(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 5, "q"), ("a", 9, "r"), ("b", 1, "s")], "seq_id string, t int, v string")
    marks = spark.createDataFrame([("a", 5), ("a", 7)], "seq_id string, mark int")
    assert rows(sequence.neighbours(df, marks), "seq_id", "t") == [("a", 1, "p", None, 5), ("a", 5, "q", 5, 7), ("a", 9, "r", 7, None), ("b", 1, "s", None, None)]
    spans = spark.createDataFrame([("a", 4, 9)], "seq_id string, start int, end int")
    assert sorted(r.t for r in sequence.windows_of(df, spans).collect()) == [5, 9]


def test_tables(spark):
    df = spark.createDataFrame([(1, 5.0, 6.0, 7.0)], "k int, p_x double, q_x double, p_y double")
    got = tables.longer_by_parts(df, ["k"], ["p_x", "q_x", "p_y"])
    assert rows(got, "name") == [(1, "x", 5.0, 6.0), (1, "y", 7.0, None)]
    odd = tables.dominant(spark.createDataFrame([("a", 1.0)] * 11 + [("a", 2.0)] * 2 + [("b", 3.0), ("c", 1.0), ("c", 2.0), ("d", None)], "u string, v double"), ["u"], "v")
    assert rows(odd, "u") == [("a", 1.0), ("b", 3.0), ("c", None)]


def days_table(spark):
    base = dict.fromkeys([c.split()[0] for c in io.RAW_DAYS.split(", ")])

    def day(n, **k):
        return {**base, "user_id": "u", "date": dt.date(2024, 1, n), **k}

    made = [
        day(1, menstruation=2, first_day=True, temperature=97.0, fluid_creamy=1, fluid_watery=2, opk=1, preg_test=2),
        day(2, menstruation=0, spotting=True, temperature=98.0, no_fluid=True, opk=2, sex=2),
        day(3, spotting=True, temperature=99.5, questionable_temp=True),
        day(6, menstruation=None, first_day=True, temperature=97.5, fluid_eggwhite=3, preg_test=1),
        day(7, menstruation=3, temperature=99.9),
    ]
    schema = io.RAW_DAYS.replace("id string, date string", "user_id string, date date", 1)
    return spark.createDataFrame([tuple(d[c.split()[0]] for c in schema.split(", ")) for d in made], schema)


def test_format_and_prepare(spark):
    got = observe.format_days(days_table(spark))
    assert rows(got.select("rel_date", "bleeding", "mucus_type", "mucus_category", "mucus_amount", "LH", "preg_test", "sex_short"), "rel_date") == [
        (1, 2.0, "watery_medium", "watery", 2, 1, -1, None), (2, 0.5, "none", "none", 0, -1, None, "unprot"), (3, None, None, None, None, None, None, None),
        (6, None, "eggwhite_lots", "eggwhite", 3, None, 1, None), (7, 3.0, None, None, None, None, None, None),
    ]
    obs = observe.prepare_obs(got)
    assert rows(obs, "t") == [
        ("u", 1, "medium", "very_fertile", -0.75, "pos", "neg"), ("u", 2, "spotting", "none", 0.25, "neg", None), ("u", 3, "none", None, None, None, None),
        ("u", 4, None, None, None, None, None), ("u", 5, None, None, None, None, None), ("u", 6, "medium", "very_fertile", -0.25, None, "pos"), ("u", 7, "heavy", None, 1.5, None, None),
    ]
    assert {r.mucus for r in observe.prepare_obs(got, missing_level=True).collect()} == {"very_fertile", "none", "missing"}
    density = observe.tracking_density(got, span=3, least=3)
    assert rows(density) == [("u", 3, True)]


def test_users_and_durations(spark):
    accounts = spark.createDataFrame([("u", "a", dt.datetime(1990, 1, 1), 28.0, None, 5.0), ("u", "b", dt.datetime(1990, 5, 1), 30.0, 14.0, 5.0)], io.ACCOUNTS)
    (r,) = observe.build_users(observe.format_days(days_table(spark)), accounts).collect()
    assert (r.n_days, r.n_temp, r.objective, r.birth_year, r.average_cycle, r.duplicated) == (5, 5, "a,b", "1990", 29.0, True)
    d = spark.createDataFrame([(1, "hM"), (1, "lM"), (1, "Rise"), (1, "hP"), (1, "hP"), (2, "Rise"), (2, "lP"), (2, "hM")], "cycle_id int, states string")
    assert rows(observe.state_durations(d), "hsmm_states") == [(1, "Lut", 3), (1, "M", 2)]


def test_tracking_class_cascade(spark):
    def block(cycle, mucus=0, temp=0, lh=0, preg=0, n=30):
        return [("a", cycle, k, "x" if k < mucus else None, 1.0 if k < temp else None, "pos" if k < lh else None, "neg" if k < preg else None) for k in range(n)]

    data = block(1, 5, 8) + block(2, 5, 7) + block(3, 4, 8) + block(4, 4, 7, lh=1) + block(5, preg=1) + block(6)
    df = spark.createDataFrame(data, "seq_id string, cycle int, t int, mucus string, temp double, LH string, preg string")
    assert rows(tracking.tracking_class(df, ["seq_id", "cycle"]).select("cycle", "tracking_behavior"), "cycle") == [(1, "BTM"), (2, "BM"), (3, "BT"), (4, "BLH"), (5, "BP"), (6, "B")]


def test_durations(spark):
    path = [(t, 1, 0.9) for t in (1, 2)] + [(t, 7, 0.9) for t in range(3, 29)] + [(29, 1, 0.9), (30, 1, 0.5), (31, 1, 0.9)] + [(40, 12, 0.8), (50, 1, 0.9), (60, 17, 0.95), (100, 1, 0.9)]
    df = spark.createDataFrame([("a", *p) for p in path], "seq_id string, t int, state int, prob double")
    got = [(r.t, r.duration, r.type) for r in cycles.event_durations(df).orderBy("t").collect()]
    assert got == [(29, 28, "cycle"), (31, 2, "cycle"), (40, 9, "pregnancy with loss"), (50, 10, "post-loss"), (60, 10, "pregnancy with birth"), (100, 40, "post-partum")]
    luteal = spark.createDataFrame([("a", t, s, p) for t, s, p in [(1, 1, 0.9), (14, 5, 0.9), (15, 6, 0.9)] + [(t, 7, 0.6) for t in range(16, 28)] + [(28, 1, 0.9)]], "seq_id string, t int, state int, prob double")
    assert rows(cycles.luteal_durations(luteal)) == [("a", 14, 13, True)]


def test_scores(spark):
    truth = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, None), ("a", 9, 1)], "seq_id string, t int, state int")
    found = spark.createDataFrame([("a", 1, 1, 0.9), ("a", 2, 1, 0.4), ("a", 3, 2, None), ("a", 4, 1, 0.5), ("a", 5, 1, 0.5)], "seq_id string, t int, state int, prob double")
    pairs = evaluate.labelled(truth, found)
    (r,) = evaluate.accuracy(pairs).collect()
    assert (r.accuracy, r.n) == (2 / 3, 3) and np.isclose(r.weighted_accuracy, 0.9 / 1.3)
    assert rows(evaluate.mean_of_states(pairs)) == [(0.75,)]
    assert {(x.truth, x.state, x.n, x.share) for x in evaluate.confusion(pairs).collect()} == {(1, 1, 1, 1.0), (2, 1, 1, 0.5), (2, 2, 1, 0.5)}
    assert {(x.group, x.value, x.n) for x in evaluate.accuracy_by_groups(pairs, ["seq_id", "truth"]).collect()} >= {("seq_id", "a", 3), ("truth", "1", 1), ("truth", "2", 2)}


def test_rule_labels():
    m = {**{t: 2 for t in (1, 2, 3, 4)}, **{t: 2 for t in (29, 30, 31)}, **{t: 2 for t in (57, 58, 59)}, **{t: 2 for t in (337, 338, 339)}}
    days = pd.DataFrame({"t": range(1, 366)})
    days["menstruation"] = [m.get(t, 0) for t in days["t"]]
    days["first_day"] = False
    days["preg_test"] = [1 if t == 90 else 0 for t in days["t"]]
    starts = plain_rules.cycle_starts(days)
    assert starts["t"].tolist() == [1, 29, 57, 337]
    assert plain_rules.period_end(days, 1) == 4 and plain_rules.period_end(days, 100) == 104
    (row,) = plain_rules.pregnancies(days, starts).itertuples()
    assert (row.start, row.test, row.end, row.kind) == (57, 90, 337, "undefined")
    label = plain_rules.label_user(days).set_index("t")["label"]
    assert label[1] == "M" and label[14] == "postO" or label[15] == "O" or label[13] == "O"
    assert label[28] == "Lut" and label[200] == "PB2" and label[309] == "B"


def test_missing_and_users(spark):
    df = spark.createDataFrame([("a", t, 1.0) for t in range(1, 11)] + [("b", t, 1.0) for t in range(1, 6)], "seq_id string, t int, x double")
    got = users.add_missing(df, ["x"], 0.3).groupBy("seq_id").agg(F.count_if(F.col("x").isNull()).alias("n"))
    assert dict(rows(got)) == {"a": 3, "b": 2}
    t = users.traits(3, 1)
    assert len(t) == 15 and set(t["tracking_category"]) <= set(users.HABITS)
    some = users.simulate_users(spark, 1, 6)
    again = users.simulate_users(spark, 1, 6)
    assert rows(some, "seq_id", "t") == rows(again, "seq_id", "t")
    assert some.filter("bleeding is null").count() == 0


@pytest.fixture(scope="module")
def simulated():
    model = dedicated(cycle_model())
    return model, simulate(model, "a", 5, transitions=40, first=1)


def test_hierarchical_decoding_beats_the_majority(simulated):
    model, days = simulated
    got = decode.decode_user(days.drop(columns=["seq_id", "state"]), model, bleeding_model(model))
    assert got["t"].tolist() == days["t"].tolist()
    assert (got["state"].to_numpy() == days["state"].to_numpy()).mean() > days["state"].value_counts(normalize=True).iloc[0]
    assert got["prob"].between(0, 1).all()


def test_stitch_averages_overlaps():
    part = lambda n, t, probs: [(ti, s, p, p == max(probs), n, "B" if n == 1 else "BT") for ti in t for s, p in enumerate(probs, 1)]
    df = pd.DataFrame(part(1, [1, 2], (0.4, 0.6)) + part(2, [2, 3], (0.9, 0.1)), columns=["t", "state", "prob", "on_path", "stretch_number", "tracking_behavior"])
    got, fix = decode.stitch(df)
    assert got["state"].tolist() == [2, 1, 1] and np.isclose(got["prob"].iloc[1], 0.65) and got["stretch_number"].tolist() == [1.0, 1.5, 2.0]
    assert got["tracking_behavior"].iloc[1] == "B-BT" and fix == [(1.5, 2, 2)]


def test_panel_and_user_give_the_same(spark, simulated):
    model, days = simulated
    days = days[days["t"] <= 120].drop(columns="state")
    plain = [tuple(None if pd.isna(v) else v for v in r) for r in days.itertuples(index=False)]
    frame_ = spark.createDataFrame(plain, "seq_id string, t int, bleeding string, mucus string, temp double, LH string, preg string")
    got = decode.decode_panel(frame_.select(*days.columns), model, bleeding_model(model)).toPandas().sort_values("t")
    want = decode.decode_user(days.drop(columns="seq_id"), model, bleeding_model(model))
    assert got["state"].tolist() == want["state"].tolist()


def test_features(spark):
    labels = ["none"] * 40
    labels[0] = labels[28] = "heavy"
    df = spark.createDataFrame([("a", t, b, None, 0.1 * (t % 3), None, "pos" if t == 35 else None) for t, b in enumerate(labels, 1)], "seq_id string, t int, bleeding string, mucus string, temp double, LH string, preg string")
    got = features.augment(df, ["bleeding_score", "bleeding_density_5d", "dtemp", "tracking", "preg_hint", "interbleeding_id"]).orderBy("t").collect()
    assert got[0].bleeding_score == 1.0 and got[28].bleeding_density_5d == 0.2 and got[0].bleeding_density_5d == 0.0
    assert got[5].dtemp == "missing" and got[30].dtemp == "no_change" and got[0].tracking
    assert got[34].preg_hint == 1.2 and got[33].preg_hint == 0.0 and got[36].preg_hint == 1.0
    assert got[26].interbleeding_id < got[27].interbleeding_id
    with pytest.raises(ValueError):
        features.augment(df, ["nothing"])


def test_autocorrelation(spark):
    df = spark.createDataFrame([("a", t, 1.0 if t % 28 == 0 else 0.0) for t in range(1, 201)], "seq_id string, t int, bleeding_score double")
    got = features.best_autocorrelation(df).filter("acf is not null").collect()
    assert len(got) == 101 and {r.acf_lag for r in got} == {28.0}


def test_forecasts(spark, simulated):
    model, _ = simulated
    part = model.subset(["M", "lE", "hE", "preO", "O", "postO", "Lut"])
    days = simulate(part, "a", 2, transitions=7, first=1)
    x = predict.cycle_length_samples(part, days, 40)
    assert 15 < x.mean() < 70
    base = predict.baseline_length(spark.createDataFrame([("a", k, n) for k, n in enumerate([28, 30, 26], 1)], "seq_id string, cycle_number int, cycle_length int"))
    assert [r.predicted for r in base.orderBy("cycle_number").collect()] == [None, 28.0, 29.0]
    long = spark.createDataFrame([("a", c, 10 * c + d, "x" if d == 2 else None) for c in (1, 2) for d in range(1, 6)], "seq_id string, cycle int, t int, mucus string")
    got = predict.replay_baseline(long, ["mucus"], -2)
    assert rows(got.filter("forecast_mucus is not null").select("cycle", "t")) == [(2, 22)]


def test_phase_tables(spark):
    path = [1] * 4 + [3] * 8 + [5] + [7] * 14
    df = spark.createDataFrame([("a", t, s) for t, s in enumerate(path * 3, 1)], "seq_id string, t int, state int")
    phases = predict.phase_table(df)
    assert {(r.phase, r.phase_length) for r in predict.mean_phase_lengths(phases).collect()} == {("follicular", 13), ("luteal", 14)}
    seen = df.withColumn("mucus", F.when(F.col("state") == 5, "fertile"))
    got = predict.observation_table(phases, seen, ["mucus"])
    assert {r.phase_day for r in got.filter("mucus = 'fertile'").collect()} == {13}


def test_phase_days_by_hand():
    path = np.array([1, 1, 2, 3, 4, 5, 7, 7, 7, 1, 1, 2, 2, 3, 4, 5, 7, 7, 1])  # follicular phases of 6 and 7 days with the ovulation, luteal of 3 and 2
    got = predict.phase_days(path, 2)
    assert got.loc[got["phase"] == "luteal", "phase_day"].tolist() == [1, 2, 3, 1, 2]
    follicular = got.loc[got["phase"] == "follicular"]
    # mean of 6.5 is taken as 6: the three days before an ovulation stand at 3 to 5, days 1 and 2 at their own place
    assert follicular["phase_day"].tolist() == [1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 6]
    assert follicular["place"].tolist() == [0, 1, 2, 3, 4, 5, 9, 10, 12, 13, 14, 15]


def test_forecasts_of_a_fifth_cycle(spark, simulated):
    model, _ = simulated
    part = model.subset(["M", "lE", "hE", "preO", "O", "postO", "Lut"])
    days = simulate(part, "a", 4, transitions=50, first=1)
    days["cycle"] = ((days["state"] == 1) & (days["state"].shift() != 1)).cumsum()
    channels = [c for c in part.emission]
    panel = spark.createDataFrame(days[["t", "cycle", *channels]].astype(object).where(days[["t", "cycle", *channels]].notna(), None).assign(seq_id="a"), "t int, cycle long, " + ", ".join(f"{c} {'double' if c == 'temp' else 'string'}" for c in channels) + ", seq_id string")
    spans = predict.training_stretches(panel)
    want = days[days["cycle"] == 5]
    assert days["cycle"].max() > 5 and {r.first_cycle for r in spans.collect()} == {1}
    got = predict.predict_lengths(spans, part).orderBy("cycleday").collect()
    assert [r.cycleday for r in got] == list(range(1, len(want) + 1)) and {r.cycle_length for r in got} == {len(want)}
    assert abs(got[-1].difference) < 12
    seen = predict.predict_observations(spans, part).collect()
    assert {r.t for r in seen} <= set(want["t"]) and {r.phase for r in seen} == {"follicular", "luteal"}
    assert all(r.phase == "follicular" and r.phase_day == 1 for r in seen if r.cycleday == 1)


def test_samples_start_where_the_last_state_began():
    model = dedicated(cycle_model()).subset(["M", "lE", "hE", "preO", "O", "postO", "Lut"])
    sojourn = np.zeros_like(model.sojourn)
    sojourn[4, :] = 1  # every state lasts five days
    from dataclasses import replace

    days = pd.DataFrame({"t": [11, 12], "bleeding": ["medium", "medium"]})
    x = predict.cycle_length_samples(replace(model, sojourn=sojourn).without([k for k in model.emission if k != "bleeding"]), days, 7)
    assert x.tolist() == [35.0] * 7


def test_going_back_in_untracked_stretches():
    model = dedicated(cycle_model())
    days = pd.DataFrame({"t": range(1, 41), "bleeding": ["none"] * 40, "mucus": ["creamy"] * 8 + [None] * 32, "preg": ["neg"] + [None] * 39})
    at = model.names.index
    for kind, want in (("BP", 0.001), ("B", 0.0)):
        own = decode.adjust(model, kind, days)
        row = model.transition[at("hE")].copy()
        row[at("lE")], row[at("Ano")] = want, 0
        assert np.allclose(own.transition[at("hE")], row / row.sum())


def starts_of(periods, tests, until=400, first=()):
    days = pd.DataFrame({"t": range(1, until + 1)})
    days["menstruation"] = [2 if any(p <= t < p + 3 for p in periods) else 0 for t in days["t"]]
    days["first_day"] = [t in first for t in days["t"]]
    days["preg_test"] = [tests.get(t, 0) for t in days["t"]]
    return plain_rules.cycle_starts(days)["t"].tolist()


def test_pregnancy_ends_by_hand():
    # a period soon after the first sign ends the pregnancy that day
    assert starts_of([1, 55], {30: 1, 45: -1}) == [1, 55]
    # a period long after the first sign ends it that day only
    assert starts_of([1, 85], {30: 1, 33: -1}) == [1, 85]
    # a period a usual cycle after the first sign ends it at the sign and starts a cycle
    assert starts_of([1, 75], {30: 1, 45: -1}) == [1, 45, 75]
    # a period that is confirmed by a negative test was the end
    assert starts_of([1, 60], {30: 1, 64: -1}) == [1, 60]
    # a positive test takes the first sign back
    assert starts_of([1, 80], {30: 1, 45: -1, 50: 1}) == [1]
    # an early positive test belongs to the cycle before
    assert starts_of([1, 29], {35: 1}) == [1]
    # late enough, the first sign ends it
    assert starts_of([1], {30: 1, 88: -1}) == [1, 88]
    # with five starts, the median of the last three gaps decides: 25 days make 50 after the test enough
    assert starts_of([1, 41, 66, 91, 116], {145: 1, 195: -1}) == [1, 41, 66, 91, 116, 195]
    assert starts_of([1, 41, 81, 106, 131], {160: 1, 210: -1}) == [1, 41, 81, 106, 131, 210]


def test_io(spark, tmp_path):
    (tmp_path / "x01ab.tsv").write_text("id\tdate\tobjective\nu\t2024-01-02 10:00:00\tNA\n")
    df = io.read_tsv(spark, f"{tmp_path}/x01ab.tsv", "id string, date string, objective string", ["id", "objective"], "file")
    (r,) = df.collect()
    assert (r.id, r.objective) == ("u", None) and r.file.endswith("x01ab.tsv")
    made = []
    for _ in range(2):
        got = io.once(spark, f"{tmp_path}/t", lambda: made.append(1) or spark.range(3))
        assert got.count() == 3
    assert len(made) == 1
    io.write_batches(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, batch string"), f"{tmp_path}/b")
    assert sorted(rows(spark.read.parquet(f"{tmp_path}/b"))) == [(1, "a"), (2, "b")]
    assert io.registry(spark, ["a", "b"], ["x"]).count() == 4
    io.save_models(spark, {"m": cycle_model()}, f"{tmp_path}/m")
    assert io.load_model(spark, f"{tmp_path}/m", "m").names == cycle_model().names
    with pytest.raises(KeyError):
        io.load_model(spark, f"{tmp_path}/m", "n")


def test_streaming(spark, sf, tmp_path):
    from rivulet.streaming import panels

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, build in (("days_out", panels.daily_counts), ("sessions_out", lambda df: panels.sessions(df, "3 days"))):
        q = build(stream).writeStream.outputMode("complete" if name == "days_out" else "append").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    want = panels.daily_counts(events)
    assert sorted(rows(spark.table("days_out"))) == sorted(rows(want))


def test_four_decodings(spark):
    part = dedicated(cycle_model()).subset(["M", "lE", "hE", "preO", "O", "postO", "Lut"])
    made = pd.concat([simulate(part, k, ord(k), days=40, first=1) for k in "ab"])
    plain = [tuple(None if pd.isna(v) else v for v in r) for r in made.drop(columns="state").itertuples(index=False)]
    panel = spark.createDataFrame(plain, "seq_id string, t int, bleeding string, mucus string, temp double, LH string, preg string").select(*made.columns[:-1])
    import numpy as np

    from rivulet.hsmm.fit import fit

    how = {"lock_transition": True, "weight_emission": 10, "most": 6}
    truth = pd.DataFrame({"seq_id": ["a", "b"], "t": [3, 9], "state": [1, 5]})
    for labels in (None, truth):
        one = fit(part, made.drop(columns="state"), labels, 0.9, **how)
        # rows of a sequence in several batches, repeated days, rows without a sequence
        messy = panel.unionByName(panel.filter("t = 7")).unionByName(panel.limit(2).withColumn("seq_id", F.lit(None).cast("string"))).repartition(5)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        try:
            many = decode.fit_jointly(messy, part, None if labels is None else spark.createDataFrame(labels, "seq_id string, t int, state int"), 0.9, **how)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert np.allclose(many.loglik, one.loglik) and many.message == one.message
        assert np.allclose(many.model.sojourn, one.model.sojourn) and np.allclose(many.model.emission["temp"].sd, one.model.emission["temp"].sd)
        assert all(np.allclose(many.model.q[k], one.model.q[k]) for k in one.model.q) and np.allclose(many.model.emission["mucus"].probs, one.model.emission["mucus"].probs)
    for jointly in (False, True):
        got = decode.four_decodings(panel, part, jointly=jointly, lock_transition=True, weight_emission=100, most=3)
        assert got.count() == 80 and got.filter("viterbi_specified between 1 and 7").count() == 80


def test_temperature_profile(spark):
    start = dt.date(2023, 1, 1)
    cycles_ = spark.createDataFrame([("u", start, start + dt.timedelta(239), True), ("u", start, start + dt.timedelta(20), False)], "user_id string, start date, end date, pregnancy boolean")
    days = spark.createDataFrame([("u", start + dt.timedelta(k), 97.0 + (k > 20)) for k in range(100)], "user_id string, date date, temperature double")
    got = {r.cycle_day: (r.median, r.n) for r in observe.temperature_profile(cycles_, days).collect()}
    assert got[10] == (0.0, 1) and got[50] == (1.0, 1)


def test_numeric_observations(spark):
    schema = "user_id string, rel_date int, LH int, preg_test int, mucus_type string, bleeding double, temperature double, questionable_temp boolean"
    days = spark.createDataFrame(
        [
            ("a", 1, 1, -1, "eggwhite_medium", 0.0, 97.0, None), ("a", 2, -1, 0, "sticky_lots", 0.0, 97.5, False), ("a", 3, 0, 1, "watery_lots", 3.0, 98.0, False),
            ("a", 4, None, None, None, None, 120.0, False), ("a", 5, None, None, "creamy_little", 1.0, 99.9, True), ("a", 9, None, None, "unknown", 0.5, 99.9, False),
            ("b", 1, None, None, None, 0.0, 97.1, False), ("b", 2, None, None, None, 0.0, 97.1, False),
        ],
        schema,
    )
    got = {(r.seq_id, r.t): tuple(r)[2:] for r in observe.numeric_observations(days).collect()}
    assert got["a", 1] == (1.0, 0.0, 0.9, -0.75, 0) and got["a", 2] == (0.0, None, 0.0, -0.25, 1)
    assert got["a", 3] == (None, 1.0, 0.0, None, 0) and got["a", 4] == (None, None, None, None, 0)
    assert got["a", 5] == (None, None, 0.1, None, 0) and got["a", 9] == (None, None, None, 1.5, 0)
    assert got["b", 1][3] is None and got["b", 2][3] is None
