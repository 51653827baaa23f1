"""The semi-Markov library against enumeration of all paths of small models."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from rivulet.hsmm import dist
from rivulet.hsmm.cycle_model import STATES, bleeding_model, cycle_model, dedicated, with_effort
from rivulet.hsmm.fit import fit
from rivulet.hsmm.infer import anchored, forward_backward, path_log_likelihood, posteriors, viterbi
from rivulet.hsmm.model import Categorical, Model, Normal, specify
from rivulet.hsmm.simulate import simulate


def small(J, seed, longest=3):
    r = np.random.default_rng(seed)
    step = r.random((J, J)) * (1 - np.eye(J)) + 1e-3 * (J == 1)
    emission = {"x": Categorical(["a", "b"], r.random((2, J)) + 0.05), "y": Normal(r.normal(size=J), 0.5 + r.random(J))}
    return specify([f"s{j}" for j in range(J)], r.random(J), step, r.random((longest, J)), emission, r.random(J) * 0.4, {"x": r.random(J) * 0.5, "y": r.random(J) * 0.5})


def records(T, seed):
    r = np.random.default_rng(seed)
    x = pd.Series(r.choice(["a", "b"], T)).mask(pd.Series(r.random(T) < 0.3))
    y = pd.Series(r.normal(size=T)).mask(pd.Series(r.random(T) < 0.3))
    return pd.DataFrame({"seq_id": 1, "t": np.arange(1, T + 1), "x": x, "y": y})


def enumerate_paths(model: Model, logb):
    """Probability of every path with its segments: {(states by day, segment ends): prob}."""
    T, J, M = len(logb), model.J, len(model.sojourn)
    out = {}

    def go(t, before, states, ends, logp):
        if t == T:
            key = (tuple(states), tuple(ends))
            out[key] = out.get(key, 0) + math.exp(logp)
            return
        for j in range(J):
            enter = model.init[j] if before is None else model.transition[before, j]
            if enter == 0:
                continue
            for n in range(1, M + 1):
                last = min(n, T - t)
                if t + n < T:
                    go(t + n, j, states + [j] * n, ends + [t + n], logp + math.log(enter * model.sojourn[n - 1, j] + 1e-320) + logb[t : t + n, j].sum())
                elif n == last:  # cut off: at least this long
                    go(T, j, states + [j] * n, ends + [T], logp + math.log(enter * model.sojourn[n - 1 :, j].sum() + 1e-320) + logb[t:T, j].sum())
        return

    go(0, None, [], [], 0.0)
    return out


@pytest.mark.parametrize("J,T,seed", [(2, 5, 1), (2, 8, 2), (3, 5, 3), (3, 6, 4), (1, 4, 5), (2, 1, 6)])
def test_against_enumeration(J, T, seed):
    model, days = small(J, seed), records(T, seed)
    logb = model.emissions(days)
    paths = enumerate_paths(model, logb)
    total = sum(paths.values())
    post = forward_backward(model, logb)
    assert math.isclose(post.loglik, math.log(total), rel_tol=1e-9, abs_tol=1e-9)
    gamma = np.zeros((T, J))
    moves, durations = np.zeros((J, J)), np.zeros((len(model.sojourn), J))
    for (states, ends), p in paths.items():
        for t, j in enumerate(states):
            gamma[t, j] += p / total
        begin = 0
        for k, end in enumerate(ends):
            j = states[begin]
            if end < T:
                moves[j, states[end]] += p / total
                durations[end - begin - 1, j] += p / total
            else:
                tail = model.sojourn[end - begin - 1 :, j]
                durations[end - begin - 1 :, j] += p / total * tail / tail.sum()
            begin = end
    assert np.allclose(post.gamma, gamma, atol=1e-9)
    assert np.allclose(post.moves, moves, atol=1e-9)
    assert np.allclose(post.durations, durations, atol=1e-9)
    path, best = viterbi(model, logb)
    top = max(paths.values())
    assert math.isclose(best, math.log(top), rel_tol=1e-9, abs_tol=1e-9)
    assert any(tuple(path - 1) == s and math.isclose(p, top, rel_tol=1e-9) for (s, _), p in paths.items())


def test_emission_formula():
    model = small(2, 7)
    days = pd.DataFrame({"t": [1, 2, 3], "x": ["a", None, "zzz"], "y": [None, 0.3, None]})
    got = np.exp(model.emissions(days))
    p, q, f = model.p, model.q, model.emission
    assert np.allclose(got[0], (1 - p) * (1 - q["x"]) * f["x"].probs[0] * q["y"])
    assert np.allclose(got[1], (1 - p) * q["x"] * (1 - q["y"]) * dist.normal(np.array(0.3), f["y"].mean, f["y"].sd))
    assert np.allclose(got[2], p + (1 - p) * q["x"] * q["y"])


def test_anchors():
    model, days = small(3, 8), records(7, 8)
    logb = model.emissions(days)
    truth = pd.DataFrame({"t": [4], "state": [2]})
    sure = forward_backward(model, anchored(logb, days["t"].to_numpy(), truth, 1.0)).gamma
    soft = forward_backward(model, anchored(logb, days["t"].to_numpy(), truth, 0.75)).gamma
    none = forward_backward(model, anchored(logb, days["t"].to_numpy(), truth, 0.0)).gamma
    plain = forward_backward(model, logb).gamma
    assert np.isclose(sure[3, 1], 1)
    assert plain[3, 1] < soft[3, 1] < 1
    assert np.allclose(none, plain)


def test_geometric_sojourns_are_a_hidden_markov_model():
    J, T, stay = 2, 6, np.array([0.6, 0.8])
    long = np.stack([dist.geometric(400, 1 - s) for s in stay], axis=1)
    base = small(J, 9)
    model = specify(base.names, base.init, base.transition, long, base.emission, base.p, base.q)
    days = records(T, 9)
    b = np.exp(model.emissions(days))
    step = np.diag(stay) + (1 - stay)[:, None] * model.transition
    alpha = [model.init * b[0]]
    for t in range(1, T):
        alpha.append(alpha[-1] @ step * b[t])
    assert math.isclose(forward_backward(model, np.log(b)).loglik, math.log(alpha[-1].sum()), rel_tol=1e-7)


def test_fit_never_lowers_the_likelihood_and_honours_locks():
    model = small(2, 10, 4)
    days = pd.concat([records(25, k).assign(seq_id=k) for k in range(4)])
    got = fit(model, days, most=15)
    assert all(b >= a - 1e-6 for a, b in zip(got.loglik, got.loglik[1:]))
    assert got.message.startswith(("Converged", "Reached"))
    locked = fit(model, days, lock_transition=True, lock_sojourn=True, lock_emission=True, most=3).model
    assert np.allclose(locked.transition, model.transition) and np.allclose(locked.sojourn, model.sojourn)
    heavy = fit(model, days, weight_emission=1e9, most=2).model
    assert np.allclose(heavy.emission["x"].probs, model.emission["x"].probs, atol=1e-4)


def test_fit_finds_a_simulated_model():
    step = np.array([[0, 1.0], [1.0, 0]])
    d = np.stack([dist.poisson(20, 4), dist.poisson(20, 8)], axis=1)
    truth = specify(["a", "b"], [1, 1], step, d, {"y": Normal(np.array([0.0, 3.0]), np.array([0.7, 0.7]))}, [0.1, 0.1], {"y": [0.1, 0.1]})
    days = pd.concat([simulate(truth, k, k, transitions=30) for k in range(6)])
    start = specify(["a", "b"], [1, 1], step, np.ones((20, 2)), {"y": Normal(np.array([0.5, 2.0]), np.array([1.0, 1.0]))}, [0.2, 0.2], {"y": [0.2, 0.2]})
    got = fit(start, days, most=40).model
    assert np.allclose(got.emission["y"].mean, [0, 3], atol=0.15)
    n = np.arange(1, 21)
    assert np.allclose((got.sojourn * n[:, None]).sum(axis=0), (truth.sojourn * n[:, None]).sum(axis=0), atol=0.9)


def test_cycle_model_decodes_what_it_simulates():
    model = dedicated(cycle_model())
    assert model.names == STATES and np.allclose(model.transition.sum(axis=1), 1) and np.allclose(model.sojourn.sum(axis=0), 1)
    days = simulate(model, "a", 3, transitions=40, first=1)
    path, _ = viterbi(model, model.emissions(days))
    gamma = forward_backward(model, model.emissions(days)).gamma
    assert np.allclose(gamma.sum(axis=1), 1)
    share = (path == days["state"]).mean()
    assert share > max(0.7, days["state"].value_counts(normalize=True).iloc[0])


def test_path_likelihood_parts_sum_to_the_viterbi_score():
    model, days = small(3, 11), records(9, 11)
    path, best = viterbi(model, model.emissions(days))
    for spread in (False, True):
        got = path_log_likelihood(model, days, path, spread)
        assert math.isclose(got["loglik"].sum(), best, abs_tol=1e-6)  # no state follows itself, so runs are segments
        assert np.isclose(got[["init", "transition", "sojourn", "emission"]].to_numpy().sum(), got["loglik"].sum())


def test_variants():
    model = cycle_model()
    short = [model.names.index(s) for s in ("M", "lE", "hE", "Lut")]
    means = lambda m: (m.sojourn * np.arange(1, len(m.sojourn) + 1)[:, None]).sum(axis=0)
    assert np.allclose(means(model.as_hmm())[short], means(model)[short], rtol=1e-3)
    assert (model.weak().sojourn[:40, short] > 0).all()
    part = model.subset(["M", "lE", "hE", "preO", "O", "postO", "Lut"])
    assert part.J == 7 and np.allclose(part.transition.sum(axis=1), 1) and np.isclose(part.init.sum(), 1)
    assert list(bleeding_model(model).emission) == ["bleeding"]
    assert np.allclose(with_effort(model, 0.8).p, model.p) and np.allclose(with_effort(model, 0.0).p, 1) and np.allclose(with_effort(model, 1.0).p, 0)
    again = Model.from_json(model.to_json())
    assert np.allclose(again.sojourn, model.sojourn) and again.names == model.names


def test_densities():
    x = np.arange(1, 400, dtype=float)
    shape, scale = dist.fit_gamma(x, dist.gamma(399, 6.0, 3.0))
    assert abs(shape - 6) < 0.2 and abs(scale - 3) < 0.1
    assert math.isclose(dist.digamma(1.0), -0.5772156649, abs_tol=1e-8) and math.isclose(dist.trigamma(1.0), math.pi**2 / 6, abs_tol=1e-8)
    assert np.isclose(dist.skew_normal(np.linspace(-60, 60, 24001), 1, 2, -2.5).sum() * 0.005, 1, atol=1e-6)
    for d in (dist.poisson(200, 5), dist.negative_binomial(400, 3, 0.3), dist.logarithmic(400, 0.7), dist.geometric(400, 0.2)):
        assert np.isclose(d.sum(), 1, atol=1e-6)
    assert np.isclose(dist.smooth(np.array([0, 1.0, 0, 0])).sum(), 1)
    curve = dist.monotone_spline(np.array([0, 0.8, 1]), np.array([1, 0.5, 0.0]), np.linspace(0, 1, 101))
    assert (np.diff(curve) <= 1e-12).all() and np.isclose(curve[80], 0.5)


def test_floor_states_cannot_be_reached():
    model = small(2, 12)
    for t, state in itertools.product((1, 3), (1, 2)):
        got = posteriors(model, records(5, 12), pd.DataFrame({"t": [t], "state": [state]}))
        assert np.isclose(got[(got.t == t) & (got.state == state)].prob.iloc[0], 1)


def test_joint_table_is_the_product_at_first():
    from rivulet.hsmm.joint import JointModel

    model = cycle_model().without(["temp"])
    joint = JointModel.of(model, {})
    days = simulate(dedicated(cycle_model()), "a", 4, days=80, first=1)
    assert np.allclose(joint.emissions(days), model.emissions(days), atol=1e-9)
    assert np.allclose(joint.table.sum(axis=0), 1)
    long = joint.long_table()
    assert len(long) == 6 * 6 * 3 * 3 and np.isclose(long["p_M"].sum(), 1)


def test_only_a_fit_finds_dependence_within_states():
    """Two states with equal margins: in one the variables rise together, in the other one falls as the other rises."""
    from rivulet.hsmm.joint import JointModel

    r = np.random.default_rng(5)
    state = np.repeat(np.tile([1, 2], 20), r.integers(15, 25, 40))
    x = r.normal(size=len(state))
    y = np.where(state == 1, x, -x) + 0.3 * r.normal(size=len(state))
    days = pd.DataFrame({"seq_id": 1, "t": np.arange(1, len(state) + 1), "x": x, "y": y})
    d = np.stack([dist.poisson(40, 19)] * 2, axis=1)
    both = {k: Normal(np.zeros(2), np.ones(2)) for k in ("x", "y")}
    model = specify(["a", "b"], [1, 1], [[0, 1], [1, 0]], d, both)
    edges = {"x": np.array([-0.8, 0, 0.8]), "y": np.array([-0.8, 0, 0.8])}
    start = JointModel.of(model, edges)
    truth = pd.DataFrame({"seq_id": 1, "t": days["t"][:40], "state": state[:40]})  # some labels tell the states apart
    plain, _ = viterbi(start, start.emissions(days))
    fitted = fit(start, days, truth, trust=0.9, lock_transition=True, lock_sojourn=True, weight_emission=10, most=30)
    path, _ = viterbi(fitted.model, fitted.model.emissions(days))
    assert (path[40:] == state[40:]).mean() > 0.9 > (plain[40:] == state[40:]).mean()


def test_registered_queries_do_the_whole_job(spark, sf):
    from pyspark.sql import functions as F

    from rivulet.plans import model_queries
    from rivulet.plans.panel import cycled

    lengths = cycled(spark, sf).filter("cycle > 0").groupBy("seq_id", "cycle").agg(F.count("*").alias("n")).collect()
    last, of = {}, {(r.seq_id, r.cycle): r["n"] for r in lengths}
    for s, c in of:
        last[s] = max(last.get(s, 0), c)
    want = [(s, c - 2, d) for (s, c), n in of.items() if c % 3 == 0 and c < last[s] for d in range(1, n + 1)]
    got = model_queries.predict_cycle_length(spark, sf).collect()
    assert want and sorted((r.seq_id, r.first_cycle, r.cycleday) for r in got) == sorted(want)
    assert all(r.cycle_length == of[r.seq_id, r.first_cycle + 2] for r in got)
    fits = model_queries.hsmm_fit_loglik(spark, sf).collect()
    assert all(r.message.startswith("Converged") or len(r.loglik) == 100 for r in fits)
