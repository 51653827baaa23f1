"""Stitching as relations against the plain form for one user."""

import random

import pandas as pd

from rivulet.hsmm.cycle_model import bleeding_model, cycle_model, dedicated
from rivulet.hsmm.simulate import simulate
from rivulet.operators import decode, stitching

SCHEMA = "seq_id string, stretch_number double, tracking_behavior string, t int, state int, prob double, on_path boolean"


def parts(r, name):
    rows, low = [], 1
    for k in range(r.randint(1, 5)):
        high = low + r.randint(3, 25)
        for t in range(low, high + 1):
            p = [round(r.random(), 2) for _ in range(3)]
            on = r.choice([0, 1, 2, 2])
            rows += [(name, float(k + 1), r.choice("XYZ") if t < 0 else "BMT"[k % 3], t, s + 1, p[s], s == on) for s in range(3)]
        low = high - r.randint(-1, 4)
    return rows


def test_panels_against_one_user(spark):
    r = random.Random(7)
    rows = [x for k in range(30) for x in parts(r, f"u{k}")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    days, found = stitching.stitched(df), stitching.seams(df)
    got = {(x.seq_id, x.t): (x.state, round(x.prob, 9), x.stretch_number, x.tracking_behavior) for x in days.collect()}
    broken = {(x.seq_id, x.stretch_number): (x.low, x.high) for x in found.collect() if x.broken}
    assert len(got) == len({(x[0], x[3]) for x in rows}) and broken
    for name in {x[0] for x in rows}:
        own = pd.DataFrame([x[1:] for x in rows if x[0] == name], columns=["stretch_number", "tracking_behavior", "t", "state", "prob", "on_path"])
        out, fix = decode.stitch(own)
        assert {t: (s, round(p, 9), n, b) for t, s, p, n, b in zip(out["t"], out["state"], out["prob"], out["stretch_number"], out["tracking_behavior"])} == {t: v for (u, t), v in got.items() if u == name}
        assert {n: (a, z) for n, a, z in fix} == {n: v for (u, n), v in broken.items() if u == name}


def test_repairs_are_unions(spark):
    days = spark.createDataFrame([("a", t, 1 if t % 20 in (3, 4) else 2, 0.9 if t != 43 else 0.5) for t in range(1, 101)], "seq_id string, t int, state int, prob double")
    cuts = spark.createDataFrame([("a", 1.5, 26, 30, True), ("a", 2.5, 45, 46, True), ("a", 3.5, 90, 92, True), ("a", 4.5, 64, 64, False)], "seq_id string, stretch_number double, low int, high int, broken boolean")
    # starts at 3, 23, 63, 83; 43 is not sure, so the first two meet
    assert {tuple(x) for x in stitching.repairs(days, cuts).collect()} == {("a", 23, 68, 1.5), ("a", 83, 100, 3.5)}
    fresh = spark.createDataFrame([("a", t, 7, 1.0) for t in range(83, 101)], days.schema)
    spans = spark.createDataFrame([("a", 83, 100)], "seq_id string, start int, end int")
    out = stitching.replaced(days, spans, fresh)
    assert out.count() == 100 and out.filter("state = 7").count() == 18


def test_decoding_by_stretch_is_that_by_user(spark):
    model = dedicated(cycle_model())
    made = pd.concat([simulate(model, k, ord(k), days=130, first=1) for k in "abcd"]).drop(columns="state")
    made.loc[(made["t"] > 60) & (made["seq_id"] < "c"), ["mucus", "temp"]] = None  # tracking that changes
    plain = [tuple(None if pd.isna(v) else v for v in row) for row in made.itertuples(index=False)]
    panel = spark.createDataFrame(plain, "seq_id string, t int, bleeding string, mucus string, temp double, LH string, preg string").select(*made.columns)
    keys = ["seq_id", "t", "state", "prob", "stretch_number", "tracking_behavior"]
    rows = lambda df: sorted((x.seq_id, x.t, x.state, round(x.prob, 6), x.stretch_number, x.tracking_behavior) for x in df.select(*keys).collect())
    bleeding = bleeding_model(model)
    assert rows(stitching.decode_by_stretch(panel, model, bleeding)) == rows(decode.decode_panel(panel, model, bleeding))
