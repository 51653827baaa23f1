"""The recursions of ``infer`` and the rounds of ``fit`` for many sequences of one length at once.

Arrays have a leading axis of sequences, so a day's step is one operation for all of them. Those of a model have it too,
of size 1 where the sequences share the model. A sequence's numbers are those that ``infer`` and ``fit`` give it alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .fit import Counts, _emission
from .joint import JointModel
from .model import FLOOR, Categorical, Model, Normal, log

#: Sequences x days x states that are computed at once: numbers of this order stay in a core's cache.
AT_ONCE = 1 << 17
Reports = dict[str, np.ndarray]  # by variable: places among its values (-1: none of them), or numbers (nan: none)


def coded(model: Model, columns: dict[str, pa.Array]) -> Reports:
    """Columns of days as reports on the model's variables; variables without a column are in none."""

    def one(f, x: pa.Array) -> np.ndarray:
        if isinstance(f, Categorical):
            return pc.fill_null(pc.index_in(x.cast(pa.string()), value_set=pa.array(f.values, pa.string())), -1).to_numpy(zero_copy_only=False)
        return x.cast(pa.float64()).to_numpy(zero_copy_only=False)

    return {k: one(f, columns[k]) for k, f in model.emission.items() if k in columns}


def by_length(lows: np.ndarray, highs: np.ndarray, states: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of sequences (rows ``lows`` to before ``highs``) of one length, and their rows, sequences x days."""
    lengths = highs - lows
    for T in np.unique(lengths[lengths > 0]):
        which, size = np.flatnonzero(lengths == T), max(1, AT_ONCE // int(T * states))
        for k in range(0, len(which), size):
            yield which[k : k + size], lows[which[k : k + size], None] + np.arange(T)


@dataclass
class Stack:
    """Models of sequences: ``head`` has the sojourns up to a sequence's length, ``rest`` the probability of longer ones."""

    init: np.ndarray
    step: np.ndarray
    head: np.ndarray
    rest: np.ndarray
    p: np.ndarray
    q: dict[str, np.ndarray]
    emission: dict[str, Categorical | Normal]

    @staticmethod
    def of(model: Model, T: int) -> Stack:
        d, M = model.sojourn, min(T, len(model.sojourn))
        rest = np.cumsum(d[:M - 1 : -1], axis=0)[-1] if M < len(d) else np.zeros(model.J)
        emission = {k: Categorical(f.values, f.probs[None]) if isinstance(f, Categorical) else Normal(f.mean[None], f.sd[None]) for k, f in model.emission.items()}
        return Stack(model.init[None], model.transition[None], d[None, :M], rest[None], model.p[None], {k: v[None] for k, v in model.q.items()}, emission)

    def map(self, f: Callable[[np.ndarray], np.ndarray]) -> Stack:
        emission = {k: Categorical(x.values, f(x.probs)) if isinstance(x, Categorical) else Normal(f(x.mean), f(x.sd)) for k, x in self.emission.items()}
        return Stack(f(self.init), f(self.step), f(self.head), f(self.rest), f(self.p), {k: f(v) for k, v in self.q.items()}, emission)

    def take(self, at: np.ndarray) -> Stack:
        return self.map(lambda x: x[at])

    def put(self, at: np.ndarray, other: Stack) -> None:
        mine: list[np.ndarray] = []
        self.map(lambda x: mine.append(x) or x)
        others = iter(mine)

        def over(x: np.ndarray) -> np.ndarray:
            next(others)[at] = x
            return x

        other.map(over)

    def reach(self, T: int, start: Model) -> Stack:
        """The same models for sequences of another length; a fit from ``start`` changes longer sojourns in proportion."""
        M, longest = self.head.shape[1], min(T, len(start.sojourn))
        if longest <= M:
            return Stack(self.init, self.step, self.head[:, :longest], self.rest + self.head[:, longest:].sum(axis=1), self.p, self.q, self.emission)
        tail = start.sojourn[M:] * (self.rest / np.maximum(start.sojourn[M:].sum(axis=0), 1e-300))[:, None]
        return Stack(self.init, self.step, np.concatenate((self.head, tail[:, : longest - M]), axis=1), tail[:, longest - M :].sum(axis=1), self.p, self.q, self.emission)

    def model(self, k: int, start: Model) -> Model:
        """The k-th model, as a fit from ``start`` gave it."""
        x = self.take(np.array([k])).reach(len(start.sojourn), start)
        own = {v: Categorical(f.values, f.probs[0]) if isinstance(f, Categorical) else Normal(f.mean[0], f.sd[0]) for v, f in x.emission.items()}
        return Model(start.names, x.init[0], x.step[0], x.head[0], own, x.p[0], {v: q[0] for v, q in x.q.items()}, start.sojourn_type)


def _known(f, x: np.ndarray) -> np.ndarray:
    return x >= 0 if isinstance(f, Categorical) else ~np.isnan(x)


def emissions(x: Stack, reports: Reports, shape: tuple[int, int]) -> np.ndarray:
    """Log probability of the reports, sequences x days x states (``Model.emissions``)."""
    B, T = shape
    reported, silent = np.zeros(shape, bool), np.ones_like(x.p)
    total = np.broadcast_to(log(1 - x.p)[:, None], (B, T, x.p.shape[-1])).copy()
    for k, f in x.emission.items():
        silent = silent * x.q[k]
        if k not in reports:
            total += log(x.q[k])[:, None]
            continue
        known = _known(f, reports[k])
        total += np.where(known[:, :, None], log(1 - x.q[k])[:, None], log(x.q[k])[:, None])
        if isinstance(f, Categorical):
            own = np.arange(B)[:, None] if len(f.probs) > 1 else 0
            density = log(f.probs)[own, np.maximum(reports[k], 0)]
        else:
            z = (np.where(known, reports[k], 0.0)[:, :, None] - f.mean[:, None]) / f.sd[:, None]
            density = log(np.exp(-0.5 * z**2) / (f.sd[:, None] * np.sqrt(2 * np.pi)))
        total += np.where(known[:, :, None], density, 0.0)
        reported |= known
    return np.maximum(np.where(reported[:, :, None], total, log(x.p + (1 - x.p) * silent)[:, None]), FLOOR)


class Lattice:
    def __init__(self, x: Stack, logb: np.ndarray):
        self.B, self.T, self.J = logb.shape
        self.init, self.step, self.d = log(x.init), log(x.step), log(x.head)
        self.tails = np.cumsum(np.concatenate((x.rest[:, None], x.head[:, ::-1]), axis=1), axis=1)[:, :0:-1]
        self.alive, self.M = log(self.tails), x.head.shape[1]
        self.sums = np.concatenate((np.zeros((self.B, 1, self.J)), np.cumsum(logb, axis=1)), axis=1)

    def ending(self, begin: np.ndarray, t: int) -> np.ndarray:
        """Segments that end on day t, by sequence, duration 1.. and state."""
        n = min(t + 1, self.M)
        starts = slice(t - n + 1, t + 1)
        last = self.alive if t == self.T - 1 else self.d
        return begin[:, starts][:, ::-1] + last[:, :n] + self.sums[:, t + 1, None] - self.sums[:, starts][:, ::-1]


def viterbi(model: Stack, logb: np.ndarray) -> np.ndarray:
    """Most likely states (1-based), sequences x days."""
    x = Lattice(model, logb)
    rows, shape = np.arange(x.B), (x.B, x.T, x.J)
    begin, end = np.empty(shape), np.empty(shape)
    came, lasted = np.zeros(shape, int), np.ones(shape, int)
    for t in range(x.T):
        if t:
            into = end[:, t - 1, :, None] + x.step
            came[:, t], begin[:, t] = into.argmax(axis=1), into.max(axis=1)
        else:
            begin[:, 0] = x.init
        of = x.ending(begin, t)
        lasted[:, t], end[:, t] = of.argmax(axis=1) + 1, of.max(axis=1)
    path, j = np.zeros((x.B, x.T), int), end[:, -1].argmax(axis=1)
    left = lasted[rows, -1, j]
    for t in range(x.T - 1, -1, -1):
        path[:, t], left = j + 1, left - 1
        over = left == 0
        if t and over.any():
            j = np.where(over, came[rows, t, j], j)
            left = np.where(over, lasted[rows, t - 1, j], left)
    return path


@dataclass
class Posterior:
    gamma: np.ndarray
    loglik: np.ndarray
    moves: np.ndarray | None
    head: np.ndarray | None  # expected sojourns up to the length, and longer ones
    rest: np.ndarray | None


LEAST = -700.0  # a part of exp(-700) of the largest changes no sum; smaller ones take long


def _spread(x: np.ndarray) -> np.ndarray:
    """Turns logs into their exponentials, by the largest along the first axis, which it returns."""
    top = x.max(axis=0)
    x -= top
    np.maximum(x, LEAST, out=x)
    np.exp(x, out=x)
    return top


def _added(x: np.ndarray) -> np.ndarray:
    top = _spread(x)
    return top + np.log(x.sum(axis=0))


def forward_backward(model: Stack, logb: np.ndarray, counts: bool = False, moves: bool = False) -> Posterior:
    """``infer.forward_backward``. Sequences are the last axis in here, so that sums over the others run along whole rows of them."""
    last_axis = lambda v: np.ascontiguousarray(np.moveaxis(v, 0, -1))
    x = Lattice(model, logb)
    init, step, d, alive, sums = (last_axis(v) for v in (x.init, x.step, x.d, x.alive, x.sums))
    shape = (x.T, x.J, x.B)
    begin, end, since = np.empty(shape), np.empty(shape), np.empty(shape)
    for t in range(x.T):
        begin[t] = _added(end[t - 1][:, None] + step) if t else init
        np.subtract(begin[t], sums[t], out=since[t])  # what does not depend on a segment's end
        n = min(t + 1, x.M)
        end[t] = _added(since[t - n + 1 : t + 1][::-1] + (alive if t == x.T - 1 else d)[:n]) + sums[t + 1]
    loglik = _added(end[-1].copy())
    after, within, until = np.zeros(shape), np.empty(shape), np.empty(shape)
    durations, cut = np.zeros((2, x.M, x.J, x.B)) if counts else (None, None)
    for t in range(x.T - 1, -1, -1):
        n = min(x.T - t, x.M)
        reaches = t + n == x.T
        np.add(sums[t + 1], after[t], out=until[t])  # what does not depend on a segment's start
        weight = until[t : t + n] + d[:n]
        if reaches:
            np.add(until[t + n - 1], alive[n - 1], out=weight[-1])
        top = _spread(weight) - sums[t]
        within[t] = top + np.log(weight.sum(axis=0))
        if counts:
            weight *= np.exp(begin[t] + top - loglik)
            if reaches:
                cut[n - 1] = weight[-1]
                weight = weight[:-1]
            durations[: len(weight)] += weight
        if t:
            after[t - 1] = _added(np.swapaxes(step, 0, 1) + within[t][:, None])
    starts, stops = np.exp(begin + within - loglik), np.exp(end + after - loglik)
    starts[1:] -= stops[:-1]
    gamma = np.clip(np.cumsum(starts, axis=0), 0, None)
    gamma /= gamma.sum(axis=1, keepdims=True)
    first_axis = lambda v: np.ascontiguousarray(np.moveaxis(v, -1, 0))
    rest = moved = None
    if counts:  # a cut-off sojourn lasts as long as others that get this far
        shares = np.cumsum(first_axis(cut) / np.maximum(x.tails, 1e-300) * (x.tails > 0), axis=1)
        durations = first_axis(durations) * (model.head > 0) + model.head * shares
        rest = model.rest * shares[:, -1]
    if moves:
        moved = np.zeros((x.J, x.J, x.B))
        for t in range(x.T - 1):
            moved += np.exp(end[t][:, None] + step + within[t + 1] - loglik)
        moved = first_axis(moved)
    return Posterior(first_axis(gamma), first_axis(loglik), moved, durations, rest)


def expected(x: Stack, reports: Reports, shape: tuple[int, int], moves: bool = True, truth: np.ndarray | None = None) -> Counts:
    """Expected counts of each sequence (``fit.expected``); ``truth`` is added to the emissions' logs."""
    logb = emissions(x, reports, shape)
    post = forward_backward(x, logb if truth is None else np.maximum(logb + truth, FLOOR), True, moves)
    gamma = post.gamma
    out = {"loglik": post.loglik, "first": gamma[:, 0], "head": post.head, "rest": post.rest, "days": gamma.sum(axis=1)} | ({"moves": post.moves} if moves else {})
    of = lambda days: np.einsum("btj,bt->bj", gamma, days.astype(float))
    reported = np.zeros(shape, bool)
    silent = np.ones_like(x.p)
    for k, f in x.emission.items():
        silent = silent * x.q[k]
        given = reports.get(k, np.full(shape, -1 if isinstance(f, Categorical) else np.nan))
        known = _known(f, given)
        reported |= known
        out[f"known {k}"] = of(known)
        if isinstance(f, Categorical):
            out[f"values {k}"] = np.stack([of(given == v) for v in range(len(f.values))], axis=1)
        else:
            number = np.where(known, given, 0.0)
            out[f"sum {k}"], out[f"squares {k}"] = of(number), of(number * number)
    out["silent"] = of(~reported) * (x.p / np.maximum(x.p + (1 - x.p) * silent, 1e-300))
    return out


def updated(x: Stack, start: Stack, counts: Counts, lock_transition: bool = False, lock_sojourn: bool = False, lock_emission: bool = False, weight_emission: float = 0.0, weight_sojourn: float = 0.0) -> Stack:
    """``fit.updated`` of each model; sojourns without a form."""
    first = counts["first"] + 1e-12 * x.init
    step, head, rest = x.step, x.head, x.rest
    if not lock_transition:
        rows = counts["moves"].sum(axis=2, keepdims=True)
        step = np.where(rows > 1e-12, counts["moves"] / np.maximum(rows, 1e-300), step)
    if not lock_sojourn:
        longer, later = counts["head"] + weight_sojourn * start.head, counts["rest"] + weight_sojourn * start.rest
        total = longer.sum(axis=1) + later
        head = np.where((total > 0)[:, None], longer / np.maximum(total, 1e-300)[:, None], head)
        rest = np.where(total > 0, later / np.maximum(total, 1e-300), rest)
    learned = {"p": x.p, "q": x.q, "emission": x.emission} if lock_emission else _emission(x, start, counts, weight_emission)
    return Stack(first / first.sum(axis=1, keepdims=True), step, head, rest, **learned)


def stackable(model: Model) -> bool:
    """Whether ``fit_each`` can fit this model; ``fit.fit`` can fit all."""
    return not isinstance(model, JointModel) and set(model.sojourn_type) <= {"nonparametric"}


def fit_each(model: Model, reports: Reports, shape: tuple[int, int], most: int = 100, tolerance: float = 1e-4, relative: float = 0.0, **how) -> tuple[Stack, list[list[float]], list[str]]:
    """A model for each sequence, its log likelihood by iteration, and how it ended (``fit.iterate``)."""
    start, live = Stack.of(model, shape[1]), np.arange(shape[0])
    now = start.take(np.zeros(shape[0], int))
    final, lls, messages = now.map(np.copy), [[] for _ in live], [f"Reached {most} iterations" for _ in live]
    before = None
    for turn in range(most):
        counts = expected(now, reports, (len(live), shape[1]), not how.get("lock_transition", False))
        ll = counts["loglik"]
        for k, value in zip(live.tolist(), ll.tolist()):
            lls[k].append(value)
        lost = ~np.isfinite(ll)
        done = lost | (turn > 2) & (np.abs(ll - before) < np.maximum(tolerance, relative * np.abs(ll))) if turn else lost
        if done.any():
            for k, failed in zip(live[done].tolist(), lost[done].tolist()):
                messages[k] = "Error: the likelihood is not finite" if failed else f"Converged after {turn + 1} iterations"
            final.put(live[done], now.take(done))
            on = ~done
            live, ll, now = live[on], ll[on], now.take(on)
            reports, counts = {k: v[on] for k, v in reports.items()}, {k: v[on] for k, v in counts.items()}
            if not len(live):
                return final, lls, messages
        before, now = ll, updated(now, start, counts, **how)
    final.put(live, now)
    return final, lls, messages
