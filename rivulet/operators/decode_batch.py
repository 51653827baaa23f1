"""Decoding of batches of sequences: what ``decode.decode_user`` does for one, with all stretches of one length at once."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa

from ..hsmm.batch import Reports, Stack, by_length, coded, emissions, forward_backward, viterbi
from ..hsmm.model import FLOOR, Model, log
from .batched import column


def decoded(model: Model, reports: Reports, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State of the most likely path and its posterior, for each row."""
    state, prob = np.zeros(edges[-1], np.int32), np.zeros(edges[-1])
    for _, rows in by_length(edges[:-1], edges[1:], model.J):
        x = Stack.of(model, rows.shape[1])
        logb = emissions(x, {k: v[rows] for k, v in reports.items()}, rows.shape)
        path = viterbi(x, logb)
        gamma = forward_backward(x, logb).gamma
        state[rows], prob[rows] = path, np.take_along_axis(gamma, path[:, :, None] - 1, axis=2)[:, :, 0]
    return state, prob


def adjusted(model: Model, kind: np.ndarray, frequency: dict[str, np.ndarray], tracked: np.ndarray, T: int, fixed_sojourns: bool = True) -> Stack:
    """``decode.adjust`` for stretches of a length: by stretch, its class, how often each variable is reported, and any.

    A variable without a report stays in the model, as one that is never reported.
    """
    n, J = len(kind), model.J
    place = {name: k for k, name in enumerate(model.names)}
    lut, he = np.isin(kind, ("B", "BP")) & fixed_sojourns, np.isin(kind, ("B", "BP", "BLH", "BT")) & fixed_sojourns
    heads, rests = [], []
    for fixed in range(4):
        d = model.sojourn
        for name, days in (("Lut", 11),) * (fixed & 1) + (("hE", 3),) * (fixed >> 1):
            if name in place and days <= len(d):
                d = d.copy()
                d[:, place[name]] = 0
                d[days - 1, place[name]] = 1
        x = Stack.of(replace(model, sojourn=d), T)
        heads.append(x.head[0])
        rests.append(x.rest[0])
    which = lut + 2 * he
    step = np.repeat(model.transition[None], n, axis=0)
    if "hE" in place and "lE" in place:
        hE, lE = place["hE"], place["lE"]
        if "mucus" in frequency:
            step[:, hE, lE] *= np.where(frequency["mucus"] > 0, frequency["mucus"], 1.0)
        step[kind == "BP", hE, lE] = 0.001
        step[kind == "B", hE, lE] = 0
    if "Ano" in place:
        step[~np.isin(kind, ("BTM", "BT")), :, place["Ano"]] = 0
    step = np.where(step.sum(axis=2, keepdims=True) == 0, model.transition, step)
    step /= step.sum(axis=2, keepdims=True)
    base = np.where(tracked > 0, 1 - tracked, 0.0)
    p, q = np.repeat(base[:, None], J, axis=1), {k: np.repeat((1 - f)[:, None], J, axis=1) for k, f in frequency.items()}

    def put(values: np.ndarray, names: str, value, where=None) -> None:
        for name in names.split():
            if name in place:
                values[:, place[name]] = value if where is None else np.where(where, value, values[:, place[name]])

    put(p, "M", np.minimum(0.2, 0.4 * base))
    put(p, "Ano L", np.minimum(0.3, 0.7 * base))
    put(p, "AB", 0.2)
    has = {k: f > 0 for k, f in frequency.items()}
    if "bleeding" in q:
        q["bleeding"][has["bleeding"]] = 0
    if "preg" in q:
        base = 1 - frequency["preg"]
        put(q["preg"], "P", base * 0.5, has["preg"])
        put(q["preg"], "Lut PB1 PL", base * 0.8, has["preg"])
    if "temp" in q:
        base = 1 - frequency["temp"]
        put(q["temp"], "P", base * 0.8, has["temp"])
        put(q["temp"], "Ano", base * 0.5, has["temp"])
    x = Stack.of(model, T)
    return Stack(x.init, step, np.stack(heads)[which], np.stack(rests)[which], p, q, x.emission)


class Stretches:
    """The days of a batch of sequences, and what stretches of them (rows ``lows`` to before ``highs``) need."""

    def __init__(self, table: pa.Table, edges: np.ndarray, model: Model, bleeding: Model, limits, channels: list[str]):
        columns = {c: column(table, c) for c in channels}
        self.model = model.without([k for k in model.emission if k not in columns])
        self.reports, self.edges, self.t, self.limits = coded(self.model, columns), edges, column(table, "t").to_numpy().astype(np.int64), limits
        self.bleeding = bleeding, coded(bleeding, {k: v for k, v in columns.items() if k == "bleeding"})
        given = {c: x.is_valid().to_numpy(zero_copy_only=False) for c, x in columns.items()}
        given |= {k: given[k] & ~np.isnan(v) for k, v in self.reports.items() if v.dtype.kind == "f"}
        total = lambda x: np.append(0, np.cumsum(x))
        self.count = {c: total(x) for c, x in given.items()}
        self.any = total(np.any([given[k] for k in self.model.emission], axis=0) if self.model.emission else np.zeros(len(self.t), bool))

    def reported(self, c: str, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        return self.count[c][highs] - self.count[c][lows] if c in self.count else np.zeros(len(lows), int)

    def kinds(self, lows: np.ndarray, highs: np.ndarray, cycles: np.ndarray) -> np.ndarray:
        """``decode.behavior`` of days that reach over so many cycles."""
        n = np.maximum(cycles, 1)
        of = {c: self.reported(c, lows, highs) for c in ("mucus", "temp", "LH", "preg")}
        mucus, temp = of["mucus"] >= self.limits.mucus * n, of["temp"] >= self.limits.temp * n
        return np.select([temp & mucus, temp, mucus, of["LH"] >= n, of["preg"] >= n], ["BTM", "BT", "BM", "BLH", "BP"], "B").astype(object)

    def run(self, lows: np.ndarray, highs: np.ndarray, kind: np.ndarray, anchor: np.ndarray, trust: float, fixed_sojourns: bool):
        """Numbers of stretches of one length, their rows, paths and posteriors; ``anchor`` has the labels of rows (0: none)."""
        J = self.model.J
        labels = np.zeros((J + 1, J))
        labels[1:] = log(np.full((J, J), (1 - trust) / J) + trust * np.eye(J))
        for which, rows in by_length(lows, highs, J):
            n = rows.shape[1]
            frequency = {k: self.reported(k, lows[which], highs[which]) / n for k in self.model.emission}
            x = adjusted(self.model, kind[which], frequency, (self.any[highs[which]] - self.any[lows[which]]) / n, n, fixed_sojourns)
            logb = np.maximum(emissions(x, {k: v[rows] for k, v in self.reports.items()}, rows.shape) + labels[anchor[rows]], FLOOR)
            yield which, rows, viterbi(x, logb), forward_backward(x, logb).gamma


def _cycles(edges: np.ndarray, menses: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each row's cycle over all sequences, and where cycles begin (with the number of rows at the end)."""
    first = np.zeros(len(menses), bool)
    first[edges[:-1]] = True
    rising = menses.copy()
    rising[1:] &= first[1:] | ~menses[:-1]
    begins = rising | first
    return np.cumsum(begins), np.append(np.flatnonzero(begins), len(menses))


def hierarchical(table: pa.Table, edges: np.ndarray, model: Model, bleeding: Model, limits, channels: list[str], sure: float, fixed_sojourns: bool = True):
    """Rows that are decoded, and their state, prob, stretch_number and tracking_behavior."""
    x = Stretches(table, edges, model, bleeding, limits, channels)
    t, M = x.t, model.state("M")
    state, prob = decoded(x.bleeding[0], x.bleeding[1], edges)
    menses = (state == bleeding.state("M")) & (prob > sure)
    cycle, begins = _cycles(edges, menses)
    at = np.isin(state, [model.state("M"), model.state("B")]) & (prob > sure) if "B" in model.names else menses
    anchor = np.where(at, state, 0)

    # stretches of cycles of one class; each ends with the next one's first period
    lows, highs = begins[:-1], begins[1:]
    kind = x.kinds(lows, highs, np.ones(len(lows), int))
    user = np.searchsorted(edges, lows, "right") - 1
    new = np.append(True, (kind[1:] != kind[:-1]) | (user[1:] != user[:-1]))
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(lows)) - 1
    period = np.minimum(np.minimum.reduceat(np.where(menses, len(t), np.arange(len(t))), lows), highs) - lows  # up to the first day without menses
    s_user, s_kind, s_low, s_end = user[heads], kind[heads], lows[heads], t[highs[tails] - 1]
    follows = np.append(s_user[1:] == s_user[:-1], False)
    s_end = s_end + np.where(follows, np.append(period[heads][1:], 0), 0)
    s_number = (np.arange(len(heads)) - np.searchsorted(s_user, s_user)) + 1
    keep = s_end > t[s_low]
    lost = np.setdiff1d(np.arange(len(edges) - 1), s_user[keep])  # sequences of single days
    whole_low, whole_high = edges[lost], edges[lost + 1]
    s_user, s_number = np.append(s_user[keep], lost), np.append(s_number[keep], np.ones(len(lost), int))
    s_kind = np.append(s_kind[keep], x.kinds(whole_low, whole_high, cycle[whole_high - 1] - cycle[whole_low] + 1))
    s_low, s_end = np.append(s_low[keep], whole_low), np.append(s_end[keep], t[whole_high - 1])
    order = np.lexsort((s_number, s_user))
    s_user, s_number, s_kind, s_low, s_end = (v[order] for v in (s_user, s_number, s_kind, s_low, s_end))
    base = t.min() if len(t) else 0
    span = t.max() - base + 2 if len(t) else 1
    line = np.repeat(np.arange(len(edges) - 1), np.diff(edges)) * span + (t - base)  # one order for days of all sequences
    until = lambda users, days: np.searchsorted(line, users * span + np.minimum(days - base, span - 1), "right")
    s_high = until(s_user, s_end)

    # a day is in two stretches at most, of which one has an odd number
    paths, gammas, of = np.zeros((2, len(t)), np.int32), np.zeros((2, len(t), model.J)), np.full((2, len(t)), -1)
    for which, rows, path, gamma in x.run(s_low, s_high, s_kind, anchor, sure, fixed_sojourns):
        for k in (0, 1):
            mine = s_number[which] % 2 == k
            r = rows[mine]
            paths[k][r], gammas[k][r], of[k][r] = path[mine], gamma[mine], which[mine, None]
    both, present = (of >= 0).all(axis=0), (of >= 0).any(axis=0)
    slot = (of[1] >= 0).astype(int)
    rows = np.arange(len(t))
    state, job = paths[slot, rows], of[slot, rows]
    prob = gammas[slot, rows, np.maximum(state, 1) - 1]
    number, behavior = s_number[job].astype(float), s_kind[job]
    mean = (gammas[0][both] + gammas[1][both]) / 2
    state[both], prob[both] = mean.argmax(axis=1) + 1, mean.max(axis=1)
    early, late = of[:, both].min(axis=0), of[:, both].max(axis=0)
    number[both] = (s_number[early] + s_number[late]) / 2
    behavior[both] = np.array([a if a == b else f"{a}-{b}" for a, b in zip(s_kind[early], s_kind[late])], object)

    # from the cycle before a seam where a stretch knows no menses to the start after it, anchored at sure cycle starts
    out = np.flatnonzero(present)
    owner = np.searchsorted(edges, out, "right") - 1
    is_m = state[out] == M
    begun = is_m & np.append(True, ~is_m[:-1] | (owner[1:] != owner[:-1])) & (prob[out] > sure)
    starts, starts_of = out[begun], owner[begun]
    redo: list[tuple[int, int, int, float]] = []  # sequence, first and last day, number
    start_set = set(starts.tolist())
    seams: dict[int, list] = {}
    for a in np.flatnonzero((s_user[1:] == s_user[:-1]) & (s_high[:-1] > s_low[1:])).tolist():
        lo, hi = s_low[a + 1], min(s_high[a], s_high[a + 1])
        if not all((paths[s_number[k] % 2, lo:hi] == M).any() for k in (a, a + 1)):
            seams.setdefault(int(s_user[a]), []).append(((s_number[a] + s_number[a + 1]) / 2, int(t[lo]), int(t[hi - 1])))
    for u, broken in seams.items():
        days = t[starts[np.searchsorted(starts_of, u) : np.searchsorted(starts_of, u, "right")]]
        first, final = int(t[edges[u]]), int(t[edges[u + 1] - 1])
        spans, joined = [], []
        for seam, low, high in broken:
            before, after = days[days < low], days[days > high]
            spans.append([int(before.max()) if len(before) else first, min(int(after.min()) + 5, final) if len(after) else final, seam])
        for span_ in sorted(spans):
            if joined and span_[0] <= joined[-1][1]:
                joined[-1][1:] = max(joined[-1][1], span_[1]), min(joined[-1][2], span_[2])
            else:
                joined.append(span_)
        redo += [(u, *s) for s in joined]
    if redo:
        users, low, high, seam = (np.array(v) for v in zip(*redo))
        r_low, r_high = until(users, low - 1), until(users, high)
        anchor = np.zeros(len(t), int)
        for u, a, b in zip(users.tolist(), low.tolist(), high.tolist()):
            for day in (a, b - 5):
                row = int(until(u, day)) - 1
                if row >= edges[u] and t[row] == day and row in start_set:
                    anchor[row] = M
        kinds = x.kinds(r_low, r_high, cycle[r_high - 1] - cycle[r_low] + 1)
        for which, rows, path, gamma in x.run(r_low, r_high, kinds, anchor, 1.0, fixed_sojourns):
            state[rows], prob[rows], present[rows] = path, np.take_along_axis(gamma, path[:, :, None] - 1, axis=2)[:, :, 0], True
            number[rows] = seam[which, None]
            behavior[rows] = kinds[which][:, None]
    out = np.flatnonzero(present)
    return out, state[out], prob[out], number[out], behavior[out]
