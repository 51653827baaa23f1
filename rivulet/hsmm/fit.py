"""Expectation maximisation, with prior weights and locks.

Each round needs no more of a sequence than its expected counts, so rounds over many sequences add these up, wherever the
sequences are (``operators.decode.fit_jointly``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd

from . import dist
from .infer import anchored, forward_backward
from .joint import JointModel
from .model import Categorical, Model, Normal


@dataclass
class Fit:
    model: Model
    loglik: list[float]
    message: str


def _sojourn(kind: str, d: np.ndarray, eta: np.ndarray, weight: float) -> np.ndarray:
    total = eta + weight * d
    if not total.sum() > 0:
        return d
    days = np.arange(1, len(d) + 1, dtype=float)
    if kind == "ksmoothed-nonparametric":
        return dist.smooth(total)
    if kind == "gamma":
        return dist.normalised(dist.gamma(len(d), *dist.fit_gamma(days, total)))
    mean = float((days * total).sum() / total.sum())
    if kind == "geometric":
        return dist.normalised(dist.geometric(len(d), min(1.0, 1 / mean)))
    if kind == "poisson":
        return dist.normalised(dist.poisson(len(d), max(mean - 1, 1e-6)))
    if kind == "lnorm":
        m = float((np.log(days) * total).sum() / total.sum())
        s = max(float(np.sqrt((total * (np.log(days) - m) ** 2).sum() / total.sum())), 1e-3)
        return dist.normalised(dist.log_normal(len(d), m, s))
    return dist.normalised(total)


Counts = dict[str, np.ndarray]


def expected(model: Model, days: pd.DataFrame, truth: pd.DataFrame | None = None, trust: float = 1.0) -> Counts:
    """What a sequence says of the model: its log likelihood and expected counts, which add up over sequences."""
    post = forward_backward(model, anchored(model.emissions(days), days["t"].to_numpy(), truth, trust))
    counts = {"loglik": np.array([post.loglik]), "first": post.first, "moves": post.moves, "durations": post.durations}
    return counts | (model.counted(days, post.gamma) if isinstance(model, JointModel) else _reported(model, days, post.gamma))


def merged(a: Counts, b: Counts) -> Counts:
    return {k: a[k] + b[k] for k in a} if a else b


def _reported(model: Model, days: pd.DataFrame, gamma: np.ndarray) -> Counts:
    known = {k: (days[k].notna() if isinstance(f, Normal) else days[k].isin(f.values)).to_numpy() if k in days else np.zeros(len(days), bool) for k, f in model.emission.items()}
    any_known = np.any(list(known.values()), axis=0) if known else np.zeros(len(days), bool)
    silent = np.prod([model.q[k] for k in model.emission], axis=0) if model.emission else np.ones(model.J)
    # of a day without reports, the part that is due to p
    by_p = model.p / np.maximum(model.p + (1 - model.p) * silent, 1e-300)
    out = {"days": gamma.sum(axis=0), "silent": (gamma[~any_known] * by_p).sum(axis=0)}
    for k, f in model.emission.items():
        g = gamma[known[k]]
        out[f"known {k}"] = g.sum(axis=0)
        if isinstance(f, Categorical):
            counts = np.zeros_like(f.probs)
            if len(g):
                np.add.at(counts, pd.Categorical(days.loc[known[k], k], f.values).codes, g)
            out[f"values {k}"] = counts
        else:
            x = days.loc[known[k], k].to_numpy(float)[:, None] if len(g) else np.zeros((0, 1))
            out[f"sum {k}"], out[f"squares {k}"] = (g * x).sum(axis=0), (g * x * x).sum(axis=0)
    return out


def updated(model: Model, start: Model, counts: Counts, lock_transition: bool = False, lock_sojourn: bool = False, lock_emission: bool = False, weight_emission: float = 0.0, weight_sojourn: float = 0.0) -> Model:
    """The most likely model for these counts; the weights count days of ``start`` as seen."""
    new = replace(model, init=dist.normalised(counts["first"] + 1e-12 * model.init))
    if not lock_transition:
        moves = counts["moves"]
        rows = moves.sum(axis=1, keepdims=True)
        new = replace(new, transition=np.where(rows > 1e-12, moves / np.maximum(rows, 1e-300), model.transition))
    if not lock_sojourn:
        kinds = model.sojourn_type or ["nonparametric"] * model.J
        new = replace(new, sojourn=np.stack([_sojourn(kinds[j], start.sojourn[:, j], counts["durations"][:, j], weight_sojourn) for j in range(model.J)], axis=1))
    if not lock_emission:
        new = replace(new, **(model.learned(start, counts["cells"], weight_emission) if isinstance(model, JointModel) else _emission(model, start, counts, weight_emission)))
    return new


def _emission(model: Model, start: Model, counts: Counts, weight: float) -> dict:
    full, none = counts["days"], counts["silent"]
    p = (none + weight * start.p) / np.maximum(full + weight, 1e-300)
    seen, q, emission = full - none, {}, {}
    for k, f in model.emission.items():
        have, prior = counts[f"known {k}"], start.emission[k]
        q[k] = np.clip((seen - have + weight * start.q[k]) / np.maximum(seen + weight, 1e-300), 0, 1)
        if isinstance(f, Categorical):
            shares = counts[f"values {k}"] + weight * prior.probs
            total = shares.sum(axis=-2, keepdims=True)
            emission[k] = Categorical(f.values, np.where(total > 1e-12, shares / np.maximum(total, 1e-300), f.probs))
        else:
            n = have + weight
            mean = np.where(n > 1e-12, (counts[f"sum {k}"] + weight * prior.mean) / np.maximum(n, 1e-300), f.mean)
            around = counts[f"squares {k}"] - 2 * mean * counts[f"sum {k}"] + mean**2 * have
            var = (around + weight * (prior.sd**2 + (prior.mean - mean) ** 2)) / np.maximum(n, 1e-300)
            emission[k] = Normal(mean, np.where(n > 1e-12, np.sqrt(np.maximum(var, 1e-4)), f.sd))
    return {"p": np.clip(p, 0, 1), "q": q, "emission": emission}


def iterate(model: Model, count, most: int = 100, tolerance: float = 1e-4, relative: float = 0.0, **how) -> Fit:
    """Fit by ``count``, which gives the counts of all sequences under a model.

    It ends when the log likelihood changes by less than ``tolerance``, or by less than the part ``relative`` of it.
    """
    start, lls = model, []
    for turn in range(most):
        counts = count(model)
        lls.append(float(counts["loglik"][0]))
        if not np.isfinite(lls[-1]):
            return Fit(model, lls, "Error: the likelihood is not finite")
        if turn > 2 and abs(lls[-1] - lls[-2]) < max(tolerance, relative * abs(lls[-1])):
            return Fit(model, lls, f"Converged after {turn + 1} iterations")
        model = updated(model, start, counts, **how)
    return Fit(model, lls, f"Reached {most} iterations")


def fit(model: Model, days: pd.DataFrame, truth: pd.DataFrame | None = None, trust: float = 1.0, **how) -> Fit:
    """``days`` (seq_id, t, variables) of one or more sequences; ``how`` as in ``iterate`` and ``updated``."""
    groups = [g.sort_values("t") for _, g in days.groupby("seq_id", sort=True)]
    labels = [None if truth is None else truth[truth["seq_id"] == g["seq_id"].iloc[0]] for g in groups]

    def count(now: Model) -> Counts:
        total: Counts = {}
        for g, lab in zip(groups, labels, strict=True):
            total = merged(total, expected(now, g, lab, trust))
        return total

    return iterate(model, count, **how)
