"""The relational rules against a plain reading of them, one user at a time."""

import random

import pandas as pd

from rivulet.operators import rules

from . import plain_rules

SCHEMA = "seq_id string, t int, menstruation int, first_day boolean, preg_test int"


def user(r, name, n):
    """Periods about every four weeks with gaps in the records, pregnancies of all lengths, and stray signs."""
    rows, next_, t = [], r.randint(1, 10), 0
    while t < n:
        t += 1 if r.random() < 0.97 else r.randint(2, 30)
        if t >= next_ + 6:
            next_ = t + r.choice([18, 22, 24, 26, 30, 34, 60, 215, 260, 300])
        bleeding = r.choice([0, 1, 2, 2, 3]) if next_ <= t < next_ + 5 else int(r.random() < 0.01)
        rows.append((name, t, r.choice([bleeding] * 9 + [None]), r.choice([False] * 60 + [True, None]), r.choice([0] * (60 if n > 60 else 6) + [None, 1, -1])))
    return rows


def table(spark):
    r = random.Random(11)
    rows = [x for k in range(45) for x in user(r, f"u{k}", r.choice([1, 20, 30, 40, 60, 300, 900]))]
    for k in range(120):  # short records with many signs, which end soon after a start
        m, first, test = ([r.choice(x) for _ in range(30)] for x in ([0, 0, 0, 2], [False] * 5 + [True], [0, 0, 0, 1, -1]))
        rows += [(f"s{k}", t + 1, m[t], first[t], test[t]) for t in range(r.randint(5, 30))]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows + [(None, 3, 2, True, 1), ("u1", None, 2, True, 1)], SCHEMA).repartition(3)


def test_starts_and_labels(spark):
    rows, days = table(spark)
    starts, labels = {}, {}
    for r in rules.cycle_starts(days).collect():
        starts.setdefault(r.seq_id, []).append(r.t)
    for r in rules.rule_based_labels(days).collect():
        assert (r.seq_id, r.t) not in labels
        labels[r.seq_id, r.t] = r.label
    n_labels = set()
    for name in {x[0] for x in rows}:
        own = pd.DataFrame([x[1:] for x in rows if x[0] == name], columns=["t", *rules.DAYS]).sort_values("t").reset_index(drop=True)
        own["first_day"] = own["first_day"].astype("boolean")
        assert sorted(starts.get(name, [])) == plain_rules.cycle_starts(own)["t"].tolist(), name
        want = plain_rules.label_user(own)
        assert {t: labels[name, t] for t in own["t"]} == dict(zip(want["t"].tolist(), want["label"].tolist())), name
        n_labels |= set(want["label"])
    assert n_labels >= {"", "M", "lE", "hE", "O", "Lut", "PB1", "PB2", "PB3", "PL", "L", "B"}


def test_periods(spark):
    rows, days = table(spark)
    ends = {(r.seq_id, r.t): r.period_end for r in rules.periods(rules.recorded(days)).collect()}
    for name in sorted({x[0] for x in rows})[:8]:
        own = pd.DataFrame([x[1:] for x in rows if x[0] == name], columns=["t", *rules.DAYS])
        assert all(ends[name, t] == plain_rules.period_end(own, t) for t in own["t"])


def test_no_rows_repeated_days_and_no_python(spark):
    assert rules.rule_based_labels(spark.createDataFrame([], SCHEMA)).collect() == []
    twice = spark.createDataFrame([("a", 1, 0, None, None), ("a", 1, 2, True, None), ("a", 2, 2, None, None)], SCHEMA)
    assert rules.rule_based_labels(twice).count() == 2
    plan = rules.rule_based_labels(twice)._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan and "Python" not in plan
