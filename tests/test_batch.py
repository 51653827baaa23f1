"""Many sequences at once against one at a time."""

import numpy as np
import pandas as pd
import pyarrow as pa

from rivulet.hsmm import batch
from rivulet.hsmm.cycle_model import cycle_model, dedicated
from rivulet.hsmm.fit import fit
from rivulet.hsmm.infer import forward_backward, viterbi
from rivulet.hsmm.simulate import simulate

OVULATORY = ["M", "lE", "hE", "preO", "O", "postO", "Lut"]


def sequences(n, T):
    return [simulate(dedicated(cycle_model()), k, k, days=T, first=1).iloc[:T].drop(columns="state") for k in range(n)]


def reports_of(model, days):
    flat = pd.concat(days)
    codes = batch.coded(model, {k: pa.array(flat[k], from_pandas=True) for k in model.emission})
    return {k: v.reshape(len(days), -1) for k, v in codes.items()}


def test_paths_and_posteriors_are_those_of_each_sequence():
    model = dedicated(cycle_model())
    for T in (1, 2, 23):
        days = sequences(5, T)
        x = batch.Stack.of(model, T)
        logb = batch.emissions(x, reports_of(model, days), (5, T))
        assert np.allclose(logb, [model.emissions(d) for d in days], atol=1e-9)
        assert (batch.viterbi(x, logb) == [viterbi(model, b)[0] for b in logb]).all()
        got = batch.forward_backward(x, logb, True, True)
        for k, b in enumerate(logb):
            one = forward_backward(model, b)
            assert np.allclose(got.gamma[k], one.gamma, atol=1e-9) and np.isclose(got.loglik[k], one.loglik)
            assert np.allclose(got.moves[k], one.moves, atol=1e-9)
            assert np.allclose(got.head[k], one.durations[:T], atol=1e-9) and np.allclose(got.rest[k], one.durations[T:].sum(axis=0), atol=1e-9)


def test_fits_are_those_of_each_sequence():
    model = dedicated(cycle_model()).subset(OVULATORY)
    for how in ({"lock_transition": True, "weight_emission": 100}, {"weight_emission": 10}):
        days = sequences(6, 25)
        got, lls, messages = batch.fit_each(model, reports_of(model, days), (6, 25), **how)
        for k, d in enumerate(days):
            one = fit(model, d.assign(seq_id=0), **how)
            assert messages[k] == one.message and np.allclose(lls[k], one.loglik, atol=1e-6)
            own = got.model(k, model)
            for a, b in ((own.sojourn, one.model.sojourn), (own.transition, one.model.transition), (own.init, one.model.init), (own.p, one.model.p), (own.emission["temp"].sd, one.model.emission["temp"].sd), (own.emission["mucus"].probs, one.model.emission["mucus"].probs)):
                assert np.allclose(a, b, atol=1e-6)


def test_panels_are_decoded_as_each_sequence(spark):
    from rivulet.hsmm.cycle_model import bleeding_model
    from rivulet.operators import decode

    r, model, panel = np.random.default_rng(3), dedicated(cycle_model()), []
    for k in range(12):
        days = simulate(model, k, k, days=150, first=1).iloc[: int(r.choice([1, 2, 90, 150]))].drop(columns="state")
        for c in ("mucus", "temp", "LH"):  # tracked in some parts only
            days[c] = days[c].mask(pd.Series(np.repeat(r.random(8) < 0.5, 20)[: len(days)], index=days.index))
        days["bleeding"] = days["bleeding"].mask(pd.Series(r.random(len(days)) < 0.4, index=days.index))
        panel.append(days.assign(seq_id=k if k else None))
    frame = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in row) for d in panel for row in d[["seq_id", "t", *decode.CHANNELS]].itertuples(index=False)], "seq_id long, t int, bleeding string, mucus string, temp double, LH string, preg string")
    frame = frame.repartition(3)
    for adaptive in (True, False):
        got = decode.decode_panel(frame, model, bleeding_model(model), adaptive=adaptive).toPandas()
        for k, days in enumerate(panel):
            want = decode.decode_user(days[["t", *decode.CHANNELS]], model, bleeding_model(model), adaptive)
            mine = got[got["seq_id"].isna() if k == 0 else got["seq_id"] == k].sort_values("t").reset_index(drop=True)
            assert mine["t"].tolist() == want["t"].tolist() and (mine["state"].to_numpy() == want["state"].to_numpy()).all()
            assert np.allclose(mine["prob"], want["prob"], atol=1e-9) and np.allclose(mine["stretch_number"], want["stretch_number"])
            assert mine["tracking_behavior"].tolist() == want["tracking_behavior"].tolist()


def test_no_query_runs_python_by_sequence(spark, sf):
    import __spark_entry__ as entry

    for name in ("hsmm_decode", "hierarchical_decode", "hsmm_posteriors", "hsmm_fit_loglik", "predict_cycle_length", "predict_next_day"):
        plan = entry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan, name


def test_a_round_of_the_joint_fit_takes_sequences_of_one_length_at_once(monkeypatch):
    from rivulet.operators import decode

    model = dedicated(cycle_model()).subset(OVULATORY)
    days = [d.assign(seq_id=k) for k, d in enumerate([*sequences(20, 9), *sequences(20, 12)])]
    flat, calls, every = pd.concat(days), [], decode.expected_many
    monkeypatch.setattr(decode, "expected_many", lambda x, reports, shape, *rest: calls.append(shape) or every(x, reports, shape, *rest))
    columns = {"seq_id": pa.array(flat["seq_id"]), "t": pa.array(flat["t"].astype("int32"))} | {k: pa.array(flat[k], from_pandas=True) for k in model.emission}
    sums = {}
    for b in decode._sums(pa.table(columns).to_batches(max_chunksize=7), model, 1.0, True):
        for name, place, value in zip(*(c.to_pylist() for c in b.columns)):
            sums.setdefault(name, {})[place] = value
    assert calls == [(20, 9), (20, 12)]
    want = {}
    for d in days:
        want = decode.merged(want, decode.expected(model, d))
    for name, value in want.items():
        assert np.allclose([sums.get(name, {}).get(k, 0.0) for k in range(value.size)], value.ravel(), atol=1e-8), name
