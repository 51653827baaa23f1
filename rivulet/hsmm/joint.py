"""Dependence between variables within a state: one table of probabilities over all combinations of reports.

Variables become levels (numbers by the bins between given edges), with one more for a missing report. The table starts
as the product that the model implies and is then learned: each iteration counts the combinations with the posteriors of
the states, and takes the starting table as ``weight`` days seen in each state.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields

import numpy as np
import pandas as pd

from .model import FLOOR, Categorical, Model, log


@dataclass
class JointModel(Model):
    edges: dict[str, np.ndarray] = field(default_factory=dict)
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # combinations x states

    @staticmethod
    def of(model: Model, edges: dict[str, np.ndarray]) -> JointModel:
        """The joint table of a model; ``edges`` cut its numeric variables to bins, open at both ends."""
        table = np.ones((1, model.J))
        for k, f in model.emission.items():
            if isinstance(f, Categorical):
                probs = f.probs
            else:
                below = np.array([[0.5 * (1 + math.erf((e - m) / (s * math.sqrt(2)))) for m, s in zip(f.mean, f.sd)] for e in edges[k]])
                probs = np.diff(np.vstack((np.zeros(model.J), below, np.ones(model.J))), axis=0)
            levels = np.vstack((model.q[k], (1 - model.q[k]) * probs))
            table = (table[:, None, :] * levels[None, :, :]).reshape(-1, model.J)
        table = table * (1 - model.p)
        table[0] += model.p  # nothing reported
        return JointModel(**{f.name: getattr(model, f.name) for f in fields(Model)}, edges={k: np.asarray(v, float) for k, v in edges.items()}, table=table)

    def cells(self, days: pd.DataFrame) -> np.ndarray:
        """Number of each day's combination; missing reports are level 0, unknown ones count as missing."""
        at = np.zeros(len(days), int)
        for k, f in self.emission.items():
            if isinstance(f, Categorical):
                size = len(f.values) + 1
                code = pd.Categorical(days[k], f.values).codes + 1 if k in days else 0
            else:
                size = len(self.edges[k]) + 2
                x = days[k].to_numpy(float) if k in days else np.full(len(days), np.nan)
                code = np.where(np.isnan(x), 0, np.searchsorted(self.edges[k], x, "right") + 1)
            at = at * size + code
        return at

    def emissions(self, days: pd.DataFrame) -> np.ndarray:
        return np.maximum(log(self.table[self.cells(days)]), FLOOR)

    def counted(self, days: pd.DataFrame, gamma: np.ndarray) -> dict[str, np.ndarray]:
        """How often each combination is reported in each state."""
        counts = np.zeros_like(self.table)
        np.add.at(counts, self.cells(days), gamma)
        return {"cells": counts}

    def learned(self, start: JointModel, counts: np.ndarray, weight: float) -> dict:
        """The part of the model that an iteration changes."""
        counts = counts + weight * start.table
        total = counts.sum(axis=0)
        return {"table": np.where(total > 1e-12, counts / np.maximum(total, 1e-300), self.table)}

    def long_table(self) -> pd.DataFrame:
        """The table as rows of levels (missing ones as None) with a probability for each state."""
        axes = [[None, *f.values] if isinstance(f, Categorical) else [None, *range(len(self.edges[k]) + 1)] for k, f in self.emission.items()]
        grid = pd.MultiIndex.from_product([range(len(a)) for a in axes]).to_frame(index=False).to_numpy()
        out = pd.DataFrame({k: pd.Series([a[i] for i in grid[:, n]], dtype=object) for n, (k, a) in enumerate(zip(self.emission, axes))})
        return out.assign(**{f"p_{name}": self.table[:, j] for j, name in enumerate(self.names)})
