"""Specification of a hidden semi-Markov model with a missing-data emission.

A state j lasts a number of days drawn from its sojourn distribution. On each
of its days, nothing is reported with probability p_j; otherwise variable k is
not reported with probability q_kj, and reported values follow its marginal
distribution in j. So a day without any report has p_j + (1 - p_j) prod q_kj,
and any other day (1 - p_j) prod (q_kj or (1 - q_kj) f_kj(x_k)).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pandas as pd

from .dist import geometric, normal, normalised, smooth

FLOOR = -1e4  # the log of what cannot be


def log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(x), FLOOR)


@dataclass
class Categorical:
    values: list[str]
    probs: np.ndarray  # values x states

    def density(self, x: pd.Series) -> np.ndarray:
        """Days x states; the rows of missing or unknown values are not meaningful."""
        at = pd.Categorical(x, self.values).codes
        return self.probs[np.maximum(at, 0)]

    def draw(self, state: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        edges = np.cumsum(self.probs, axis=0)[:, state]
        return np.array(self.values, object)[np.minimum((rng.random(len(state)) > edges).sum(axis=0), len(self.values) - 1)]


@dataclass
class Normal:
    mean: np.ndarray
    sd: np.ndarray

    def density(self, x: pd.Series) -> np.ndarray:
        return normal(x.to_numpy(float)[:, None], self.mean, self.sd)

    def draw(self, state: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return rng.normal(self.mean[state], self.sd[state])


@dataclass
class Model:
    names: list[str]
    init: np.ndarray
    transition: np.ndarray
    sojourn: np.ndarray  # days x states
    emission: dict[str, Categorical | Normal]
    p: np.ndarray
    q: dict[str, np.ndarray]
    sojourn_type: list[str] = field(default_factory=list)

    @property
    def J(self) -> int:
        return len(self.names)

    def state(self, name: str) -> int:
        """1-based number of a state."""
        return self.names.index(name) + 1

    def emissions(self, days: pd.DataFrame) -> np.ndarray:
        """Log probability of each day's reports in each state."""
        n = len(days)
        reported, total, silent = np.zeros(n, bool), np.tile(log(1 - self.p), (n, 1)), np.ones(self.J)
        for k, f in self.emission.items():
            known = days[k].notna().to_numpy() if k in days else np.zeros(n, bool)
            if isinstance(f, Categorical) and k in days:
                known &= days[k].isin(f.values).to_numpy()
            silent = silent * self.q[k]
            total += np.where(known[:, None], log(1 - self.q[k]), log(self.q[k]))
            if known.any():
                total[known] += log(f.density(days.loc[known, k]))
            reported |= known
        total[~reported] = log(self.p + (1 - self.p) * silent)
        return np.maximum(total, FLOOR)

    def without(self, variables: list[str]) -> Model:
        return replace(self, emission={k: v for k, v in self.emission.items() if k not in variables}, q={k: v for k, v in self.q.items() if k not in variables})

    def subset(self, names: list[str]) -> Model:
        """The model of these states alone, renormalised; states that lead nowhere start again by ``init``."""
        at = [self.names.index(n) for n in names]
        step = self.transition[np.ix_(at, at)].copy()
        init = normalised(self.init[at])
        step[step.sum(axis=1) == 0] = init
        emission = {k: Categorical(f.values, f.probs[:, at]) if isinstance(f, Categorical) else Normal(f.mean[at], f.sd[at]) for k, f in self.emission.items()}
        kinds = [self.sojourn_type[i] for i in at] if self.sojourn_type else []
        return Model([self.names[i] for i in at], init, step / step.sum(axis=1, keepdims=True), self.sojourn[:, at], emission, self.p[at], {k: v[at] for k, v in self.q.items()}, kinds)

    def as_hmm(self) -> Model:
        """Geometric sojourns with the same means."""
        days = np.arange(1, len(self.sojourn) + 1)
        prob = 1 / (self.sojourn * days[:, None]).sum(axis=0)
        d = np.stack([normalised(geometric(len(days), min(1.0, x))) for x in prob], axis=1)
        return replace(self, sojourn=d, sojourn_type=["geometric"] * self.J)

    def weak(self, widths: np.ndarray | None = None) -> Model:
        """Sojourns blurred by a normal kernel of about their own spread."""
        days = np.arange(1, len(self.sojourn) + 1)
        mean = (self.sojourn * days[:, None]).sum(axis=0)
        sd = np.sqrt((self.sojourn * (days[:, None] - mean) ** 2).sum(axis=0))
        widths = np.ceil(sd + 0.1) + 3 if widths is None else widths
        return replace(self, sojourn=np.stack([smooth(self.sojourn[:, j], widths[j]) for j in range(self.J)], axis=1))

    def to_json(self) -> str:
        emission = {k: {"values": f.values, "probs": f.probs.tolist()} if isinstance(f, Categorical) else {"mean": f.mean.tolist(), "sd": f.sd.tolist()} for k, f in self.emission.items()}
        rows = {"names": self.names, "init": self.init.tolist(), "transition": self.transition.tolist(), "sojourn": self.sojourn.tolist(), "emission": emission, "p": self.p.tolist(), "q": {k: v.tolist() for k, v in self.q.items()}, "sojourn_type": self.sojourn_type}
        return json.dumps(rows)

    @staticmethod
    def from_json(text: str) -> Model:
        x = json.loads(text)
        emission = {k: Categorical(v["values"], np.array(v["probs"])) if "values" in v else Normal(np.array(v["mean"]), np.array(v["sd"])) for k, v in x["emission"].items()}
        return Model(x["names"], np.array(x["init"]), np.array(x["transition"]), np.array(x["sojourn"]), emission, np.array(x["p"]), {k: np.array(v) for k, v in x["q"].items()}, x["sojourn_type"])


def specify(names, init, transition, sojourn, emission, p=None, q=None, sojourn_type=None) -> Model:
    """A checked model: everything that is a distribution is normalised, and the sojourn is cut to its support."""
    J = len(names)
    init, step, d = normalised(np.asarray(init, float)), np.asarray(transition, float), np.asarray(sojourn, float)
    if step.shape != (J, J) or d.shape[1:] != (J,) or (step < 0).any() or (d < 0).any():
        raise ValueError("transition must be states x states and sojourn days x states, without negative values")
    if not (step.sum(axis=1) > 0).all() or not (d.sum(axis=0) > 0).all():
        raise ValueError("every state needs a successor and a duration")
    d = d[: np.flatnonzero(d.sum(axis=1))[-1] + 1]
    checked = {}
    for k, f in emission.items():
        if isinstance(f, Categorical):
            probs = np.asarray(f.probs, float)
            if probs.shape != (len(f.values), J):
                raise ValueError(f"{k} needs a probability for each value and state")
            f = Categorical(list(f.values), probs / probs.sum(axis=0))
        else:
            f = Normal(np.broadcast_to(np.asarray(f.mean, float), J).copy(), np.broadcast_to(np.asarray(f.sd, float), J).copy())
        checked[k] = f
    p = np.zeros(J) if p is None else np.asarray(p, float)
    q = {k: np.asarray((q or {}).get(k, np.zeros(J)), float) for k in checked}
    return Model(list(names), init, step / step.sum(axis=1, keepdims=True), d / d.sum(axis=0), checked, p, q, list(sojourn_type or ["nonparametric"] * J))


@lru_cache(8)
def stored(text: str) -> Model:
    """The model of this JSON, read once by each process."""
    return Model.from_json(text)
