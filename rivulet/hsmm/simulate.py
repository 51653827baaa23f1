"""Sequences drawn from a model."""

from __future__ import annotations

import numpy as np
import pandas as pd

from .model import Model


def states(model: Model, rng: np.random.Generator, transitions: int | None = None, days: int | None = None, first: int | None = None) -> np.ndarray:
    """A path (1-based) of so many segments or days."""
    if transitions is None and days is None:
        raise ValueError("a number of transitions or of days is needed")
    out, j, n, segments = [], (first - 1 if first else int(rng.choice(model.J, p=model.init))), 0, 0
    support = np.arange(1, len(model.sojourn) + 1)
    while (transitions is None or segments < transitions) and (days is None or n < days):
        last = int(rng.choice(support, p=model.sojourn[:, j]))
        out.append(np.full(last, j + 1))
        n, segments = n + last, segments + 1
        j = int(rng.choice(model.J, p=model.transition[j]))
    path = np.concatenate(out)
    return path[:days] if days is not None else path


def observe(model: Model, path: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """Reports on each day of a path, with missing ones."""
    silent = rng.random(len(path)) < model.p[path - 1]
    got = {}
    for k, f in model.emission.items():
        value = pd.Series(f.draw(path - 1, rng), dtype=object if hasattr(f, "values") else float)
        got[k] = value.mask(silent | (rng.random(len(path)) < model.q[k][path - 1]))
    return pd.DataFrame(got)


def simulate(model: Model, seq_id, seed: int, transitions: int | None = None, days: int | None = None, first: int | None = None) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    path = states(model, rng, transitions, days, first)
    out = observe(model, path, rng)
    out.insert(0, "seq_id", seq_id)
    out.insert(1, "t", np.arange(1, len(path) + 1))
    return out.assign(state=path)
