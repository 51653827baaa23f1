"""Most likely paths and posteriors of explicit-duration models.

The recursions run over segments. ``begin[t, j]`` stands for all beginnings up
to a segment of j that starts on day t, ``end[t, j]`` for one that ends on day
t. The last segment is cut off by the end of the records, so it has the
probability of lasting at least that long. All is in logs; a segment's
emissions are a difference of two prefix sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd

from .model import FLOOR, Model, log


def add(x: np.ndarray, axis: int) -> np.ndarray:
    """log(sum(exp(x))) along an axis."""
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def anchored(logb: np.ndarray, days: np.ndarray, truth: pd.DataFrame | None, trust: float = 1.0) -> np.ndarray:
    """Emissions under labels (t, state, optionally trust): a share ``trust`` of the belief goes to the named state."""
    if truth is None or not len(truth):
        return logb
    logb, J = logb.copy(), logb.shape[1]
    place = {int(t): k for k, t in enumerate(days)}
    how = truth["trust"] if "trust" in truth else pd.Series(trust, index=truth.index)
    for t, state, w in zip(truth["t"], truth["state"], how, strict=True):
        if int(t) in place:
            factor = np.full(J, (1 - w) / J)
            factor[int(state) - 1] += w
            logb[place[int(t)]] += log(factor)
    return np.maximum(logb, FLOOR)


@dataclass
class Lattice:
    """What both recursions need of a model and a sequence."""

    logb: np.ndarray
    init: np.ndarray
    step: np.ndarray
    d: np.ndarray
    alive: np.ndarray

    def __init__(self, model: Model, logb: np.ndarray):
        self.logb, self.T = logb, len(logb)
        self.init, self.step = log(model.init), log(model.transition)
        self.d = log(model.sojourn[: self.T])
        tail = np.cumsum(model.sojourn[::-1], axis=0)[::-1]
        self.alive = log(tail[: self.T])
        if len(self.alive) < self.T:
            pad = np.full((self.T - len(self.alive), model.J), FLOOR)
            self.d, self.alive = np.vstack((self.d, pad)), np.vstack((self.alive, pad))
        self.M = min(self.T, len(model.sojourn))
        self.sums = np.vstack((np.zeros(model.J), np.cumsum(logb, axis=0)))

    def ending(self, begin: np.ndarray, t: int) -> np.ndarray:
        """Segments that end on day t, by duration 1.. and state."""
        n = min(t + 1, self.M)
        starts = np.arange(t, t - n, -1)
        last = self.alive if t == self.T - 1 else self.d
        return begin[starts] + last[:n] + self.sums[t + 1] - self.sums[starts]


def viterbi(model: Model, logb: np.ndarray) -> tuple[np.ndarray, float]:
    """Most likely states (1-based) and the log probability of path and records."""
    x, J = Lattice(model, logb), model.J
    begin, end = np.full((x.T, J), FLOOR * 1e3), np.full((x.T, J), FLOOR * 1e3)
    came, lasted = np.zeros((x.T, J), int), np.ones((x.T, J), int)
    for t in range(x.T):
        if t:
            into = end[t - 1][:, None] + x.step
            came[t], begin[t] = into.argmax(axis=0), into.max(axis=0)
        else:
            begin[0] = x.init
        of = x.ending(begin, t)
        lasted[t], end[t] = of.argmax(axis=0) + 1, of.max(axis=0)
    path, t, j = np.zeros(x.T, int), x.T - 1, int(end[-1].argmax())
    best = float(end[-1].max())
    while t >= 0:
        n = lasted[t, j]
        path[t - n + 1 : t + 1] = j + 1
        j, t = came[t - n + 1, j], t - n
    return path, best


@dataclass
class Posterior:
    gamma: np.ndarray  # days x states
    loglik: float
    first: np.ndarray  # states on the first day
    moves: np.ndarray  # expected transitions
    durations: np.ndarray  # expected sojourns, days x states


def forward_backward(model: Model, logb: np.ndarray) -> Posterior:
    x, J = Lattice(model, logb), model.J
    begin, end = np.empty((x.T, J)), np.empty((x.T, J))
    for t in range(x.T):
        begin[t] = add(end[t - 1][:, None] + x.step, 0) if t else x.init
        end[t] = add(x.ending(begin, t), 0)
    loglik = float(add(end[-1], 0))
    after, within = np.zeros((x.T, J)), np.empty((x.T, J))  # log of all ends of the records after / from a segment's start
    durations = np.zeros_like(model.sojourn)
    for t in range(x.T - 1, -1, -1):
        n = min(x.T - t, x.M)
        stops = np.arange(t, t + n)
        last = x.d[:n].copy()
        reaches = t + n == x.T
        if reaches:
            last[-1] = x.alive[n - 1]
        segments = last + x.sums[stops + 1] - x.sums[t] + after[stops]
        within[t] = add(segments, 0)
        weight = np.exp(begin[t] + segments - loglik)
        if reaches:  # a cut-off sojourn lasts as long as others that get this far
            tail = model.sojourn[n - 1 :]
            durations[n - 1 :] += weight[-1] * tail / np.maximum(tail.sum(axis=0), 1e-300)
            weight = weight[:-1]
        durations[: len(weight)] += weight
        if t:
            after[t - 1] = add(x.step + within[t], 1)
    starts = np.exp(begin + within - loglik)
    stops = np.exp(end + after - loglik)
    stops[-1] = 0
    gamma = np.cumsum(starts - np.vstack((np.zeros(J), stops[:-1])), axis=0)
    gamma = np.clip(gamma, 0, None)
    gamma /= gamma.sum(axis=1, keepdims=True)
    moves = np.exp(end[:-1, :, None] + x.step + within[1:, None, :] - loglik).sum(axis=0) if x.T > 1 else np.zeros((J, J))
    return Posterior(gamma, loglik, gamma[0], moves, durations)


def decode(model: Model, days: pd.DataFrame, truth: pd.DataFrame | None = None, trust: float = 1.0) -> pd.DataFrame:
    """One sequence (t and variables, by day) -> t, state (most likely path), prob (its posterior)."""
    logb = anchored(model.emissions(days), days["t"].to_numpy(), truth, trust)
    path, _ = viterbi(model, logb)
    gamma = forward_backward(model, logb).gamma
    return pd.DataFrame({"t": days["t"].to_numpy(), "state": path, "prob": gamma[np.arange(len(path)), path - 1]})


def posteriors(model: Model, days: pd.DataFrame, truth: pd.DataFrame | None = None, trust: float = 1.0) -> pd.DataFrame:
    """All states of all days: t, state, prob."""
    gamma = forward_backward(model, anchored(model.emissions(days), days["t"].to_numpy(), truth, trust)).gamma
    T, J = gamma.shape
    return pd.DataFrame({"t": np.repeat(days["t"].to_numpy(), J), "state": np.tile(np.arange(1, J + 1), T), "prob": gamma.ravel()})


def path_log_likelihood(model: Model, days: pd.DataFrame, path: np.ndarray, spread: bool = False) -> pd.DataFrame:
    """Parts of the log likelihood of a path by day: init, transition, sojourn, emission.

    A sojourn counts on its first day, or is ``spread`` evenly over its days.
    """
    logb, T = model.emissions(days), len(path)
    x = Lattice(model, logb)
    out = np.zeros((T, 4))
    out[0, 0] = x.init[path[0] - 1]
    out[:, 3] = logb[np.arange(T), path - 1]
    t = 0
    while t < T:
        stop = t
        while stop < T and path[stop] == path[t]:
            stop += 1
        if t:
            out[t, 1] = x.step[path[t - 1] - 1, path[t] - 1]
        table, n = (x.alive if stop == T else x.d), stop - t
        value = table[n - 1, path[t] - 1]
        if spread:
            out[t:stop, 2] = value / n
        else:
            out[t, 2] = value
        t = stop
    got = pd.DataFrame(out, columns=["init", "transition", "sojourn", "emission"])
    got.insert(0, "t", days["t"].to_numpy())
    return got.assign(loglik=out.sum(axis=1))
