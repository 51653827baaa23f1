"""Path likelihoods by joins against a plain reading of their definition."""

import math
import random

import numpy as np
import pytest

from rivulet.hsmm.model import FLOOR, Categorical, Normal, specify
from rivulet.operators.likelihood import TERMS, path_likelihood

SCHEMA = "seq_id string, t int, state int, sign string, temp double, more int"


def model():
    return specify(
        ["A", "B", "C"], [2, 1, 0], [[0, 1, 1], [1, 0, 0], [1, 1, 0]], [[1, 0, 2], [1, 3, 1], [2, 1, 0]],
        {"sign": Categorical(["x", "y"], np.array([[3.0, 1, 0], [1, 1, 1]])), "temp": Normal(np.array([0.0, 1.0, 2.0]), np.array([1.0, 0.5, 2.0]))},
        p=[0.1, 0.3, 0.0], q={"sign": [0.2, 0.0, 0.5], "temp": [0.0, 0.5, 0.9]},
    )


def lg(x):
    return max(math.log(x), FLOOR) if x > 0 else FLOOR


def plain(days, m, spread):
    """days of one sequence: (t, state, sign, temp) in order."""
    n = len(days)
    out = [[0.0, 0.0, 0.0, None] for _ in days]
    runs, k = [], 0
    while k < n:
        stop = k
        while stop < n and days[stop][1] == days[k][1]:
            stop += 1
        runs.append((k, stop))
        k = stop
    for r, (lo, hi) in enumerate(runs):
        state, first, last = days[lo][1], r == 0, r == len(runs) - 1
        if state is None:
            continue
        length = hi - lo
        at = range(lo, hi) if spread else [lo]
        share = length if spread else 1
        for i in at:
            if first:
                out[i][0] = lg(m.init[state - 1]) / share
            elif days[lo - 1][1] is not None:
                out[i][1] = lg(m.transition[days[lo - 1][1] - 1, state - 1]) / share
        stay = lg(m.sojourn[length - 1, state - 1]) if length <= len(m.sojourn) else FLOOR
        for i in range(lo, hi) if spread else [hi - 1]:
            if not (first or last) if spread else 0 < i < n - 1:
                out[i][2] = stay / share
    for i, (_, state, sign, temp) in enumerate(days):
        if state is None:
            continue
        j = state - 1
        known = {"sign": sign in ("x", "y"), "temp": temp is not None}
        if not any(known.values()):
            out[i][3] = lg(m.p[j] + (1 - m.p[j]) * m.q["sign"][j] * m.q["temp"][j])
            continue
        total = lg(1 - m.p[j])
        total += lg(1 - m.q["sign"][j]) + lg(m.emission["sign"].probs[["x", "y"].index(sign), j]) if known["sign"] else lg(m.q["sign"][j])
        if known["temp"]:
            z = (temp - m.emission["temp"].mean[j]) / m.emission["temp"].sd[j]
            total += lg(1 - m.q["temp"][j]) + max(-z * z / 2 - math.log(m.emission["temp"].sd[j] * math.sqrt(2 * math.pi)), FLOOR)
        else:
            total += lg(m.q["temp"][j])
        out[i][3] = max(total, FLOOR)
    return out


@pytest.mark.parametrize("spread", [False, True])
def test_terms_by_day(spark, spread):
    r, rows = random.Random(3), []
    for s in range(12):
        t, state = 0, 1
        for _ in range(r.randint(1, 25)):
            t += r.choice([1, 1, 1, 2])
            state = state if r.random() < 0.6 else r.choice([1, 2, 3, 3, None])
            rows.append((f"s{s}", t, state, r.choice(["x", "y", "other", None]), r.choice([None, round(r.gauss(0, 2), 2)]), 0))
    rows += [("alone", 5, 2, None, None, 0), ("long", 1, 1, "x", 0.0, 0), *[("long", t, 2, "x", 50.0, 0) for t in range(2, 9)], ("long", 9, 1, None, None, 0)]
    got = path_likelihood(spark.createDataFrame(rows, SCHEMA).repartition(3), model(), spread)
    found = {(x["seq_id"], x["t"]): [x[c] for c in (*TERMS, "loglik")] for x in got.collect()}
    assert len(found) == len(rows)
    for s in {x[0] for x in rows}:
        days = [(t, state, sign, temp) for q, t, state, sign, temp, _ in rows if q == s]
        for (t, *_), want in zip(days, plain(days, model(), spread)):
            mine = found[s, t]
            assert mine[:3] == pytest.approx(want[:3]) and (mine[3] is None) == (want[3] is None)
            if want[3] is not None:
                assert mine[3] == pytest.approx(want[3]) and mine[4] == pytest.approx(sum(want))


def test_no_rows_and_a_channel_that_is_not_there(spark):
    assert path_likelihood(spark.createDataFrame([], SCHEMA), model()).collect() == []
    got = path_likelihood(spark.createDataFrame([("a", 1, 1, 0.5)], "seq_id string, t int, state int, temp double"), model()).first()
    assert got.emission == pytest.approx(math.log(0.9) + math.log(0.2) + math.log(1 - 0.0) - 0.125 - math.log(math.sqrt(2 * math.pi)))


def test_one_sort_and_no_python(spark):
    df = spark.createDataFrame([("a", 1, 1, "x", 0.5, 0)], SCHEMA)
    plan = path_likelihood(df, model())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
