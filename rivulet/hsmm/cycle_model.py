"""The 19-state model of cycles, pregnancies and their losses, and variants of it."""

from __future__ import annotations

from dataclasses import replace

import numpy as np

from .dist import gamma, monotone_spline, normal, normalised, skew_normal
from .model import Categorical, Model, Normal, specify

# --- fixed values: the model's published parameters -------------------------------------------------
STATES = ["M", "lE", "hE", "preO", "O", "postO", "Lut", "Ano", "AB", "P", "PL", "L", "lEpL", "PB1", "PB2", "PB3", "B", "PP", "BF"]
INIT = {"M": 100, "PB1": 0, "PB2": 0, "PB3": 0, "PL": 0}  # others 1
TRANSITIONS = {
    "M": {"lE": 0.99, "AB": 0.01}, "AB": {"M": 1}, "lE": {"hE": 1}, "hE": {"lE": 0.01, "preO": 0.95, "Ano": 0.02}, "Ano": {"M": 1},
    "preO": {"O": 1}, "O": {"postO": 1}, "postO": {"Lut": 0.9, "P": 0.1}, "Lut": {"M": 1}, "P": {"PL": 0.3, "PB1": 0.7}, "PL": {"L": 1},
    "L": {"lEpL": 1}, "lEpL": {"hE": 1}, "PB1": {"PB2": 1}, "PB2": {"PB3": 1}, "PB3": {"B": 1}, "B": {"PP": 0.2, "BF": 0.8}, "PP": {"hE": 1}, "BF": {"hE": 1},
}
LONGEST = 1000
BLEEDING = ["none", "spotting", "light", "medium", "heavy"]
BLEEDING_PROBS = {
    "": (0.99, 0.01, 0.001, 1e-4, 1e-4), "AB": (0.2, 0.5, 0.2, 0.05, 0.01),
    "O Lut Ano P PL lEpL PB1 PP": (0.85, 0.15, 0.001, 5e-4, 1e-4), "M L B": (0.05, 0.1, 0.4, 0.5, 0.5),
}
LH_POS = {"": 0.05, "lE": 0.1, "hE lEpL": 0.2, "preO": 0.7, "O P PL PB1 PB2 PB3": 0.8, "postO": 0.2}
MUCUS = ["none", "creamy", "fertile", "very_fertile", "sticky"]
MUCUS_PROBS = {
    "": (100, 10, 1, 1, 1), "lE lEpL Ano": (40, 50, 10, 5, 20), "hE preO O": (10, 20, 30, 60, 25), "postO Lut P": (60, 30, 10, 10, 60),
    "PL PB1 PB2 PB3 PP BF": (1.5, 1.5, 1, 1, 1),
}
TEMP_MEAN = {"": -0.3, "postO": 0.3, "Lut P PL PB1": 0.6, "M preO O BF B L": 0}
TEMP_SD = {"": 0.2, "M L PB2 PB3 B PP BF": 0.5}
PREG_POS = {"": 0.05, "P PB1 PB2 PB3": 0.9, "PL": 0.8 / 0.9, "L lEpL": 0.5, "BF": 0.02}
P_MISSING = {"": 0.5, "M": 0.1, "AB": 0.2, "lE Lut Ano lEpL": 0.4, "hE preO O postO L": 0.3, "PL PB1": 0.9, "PB2 PB3 PP": 0.98, "BF": 0.99}
Q_MISSING = {
    "bleeding": {"": 0}, "LH": {"": 0.99, "hE preO O postO": 0.5},
    "mucus": {"": 0.5, "hE preO O postO": 0.4, "Ano": 0.1, "M L B AB": 0.99, "P PB1 PL": 0.9, "PB2 PB3 PP BF": 0.99},
    "temp": {"": 0.5, "M lEpL": 0.85, "PB1 PL": 0.9, "L PB2 PB3 B PP BF": 0.99},
    "preg": {"": 0.99, "Lut": 0.9, "P lEpL": 0.6, "PB1 PL": 0.95},
}
DEDICATED_P = {"M": 0.01, "lE Lut Ano AB P L lEpL": 0.05, "hE preO O postO": 0.025, "PL PB1 PP": 0.9, "PB2 PB3 BF": 0.98, "B": 0.2}
DEDICATED_Q = {
    "LH": {"hE": 0.3, "preO O": 0.1}, "mucus": {"hE preO O postO": 0.1}, "temp": {"hE preO O postO Ano": 0.1, "Lut P": 0.3, "PL PB1": 0.75},
}
#: States, first and last day that they can last, shape of the sojourn and its parameters ("range": see SOJOURN_RANGES).
SOJOURNS = (
    ("M L", 2, 9, "range", "M"), ("lE lEpL", 1, 29, "range", "lE"), ("hE", 1, LONGEST, "range", "hE"), ("preO O", 1, 1, "flat"), ("postO", 2, 2, "flat"),
    ("Lut", 7, 17, "range", "Lut"), ("Ano", 7, LONGEST, "range", "Ano"), ("AB", 8, 100, "flat"), ("P", 17, 17, "flat"), ("PL", 1, 154, "gamma", 1.5, 30),
    ("PB1 PB2", 84, 84, "flat"), ("PB3", 6, 111, "skew normal", 84, 12, -2.5), ("B", 1, 31, "gamma", 1.25, 5), ("PP", 19, 56, "normal", 35, 10), ("BF", 57, LONGEST, "gamma", 2.5, 300),
)
# --- end of the fixed values ------------------------------------------------------------------------

#: Gamma sojourns (mean, sd) in days. The records they were once fitted to are not public; these are from the ranges
#: that the literature gives for the phases of a cycle.
SOJOURN_RANGES = {"M": (5.0, 1.3), "lE": (6.0, 4.0), "hE": (5.0, 3.0), "Lut": (11.0, 2.0), "Ano": (14.0, 3.0)}


def by_state(groups: dict, width: int | None = None) -> np.ndarray:
    """An array by state from values for groups of names; "" is the default."""
    out = np.array([groups.get("", 0) if width is None else groups[""] for _ in STATES], float)
    for names, value in groups.items():
        for name in names.split():
            out[STATES.index(name)] = value
    return out


def sojourns() -> np.ndarray:
    x = np.arange(1, LONGEST + 1)
    d = np.zeros((LONGEST, len(STATES)))

    def put(names: str, values: np.ndarray) -> None:
        for name in names.split():
            d[:, STATES.index(name)] = normalised(values)

    def of(name: str) -> np.ndarray:
        mean, sd = SOJOURN_RANGES[name]
        return gamma(LONGEST, (mean / sd) ** 2, sd * sd / mean)

    shapes = {
        "range": of, "gamma": lambda shape, scale: gamma(LONGEST, shape, scale), "normal": lambda mean, sd: normal(x, mean, sd),
        "skew normal": lambda place, scale, skew: skew_normal(x, place, scale, skew), "flat": lambda: np.ones(LONGEST),
    }
    for names, first, last, shape, *parameters in SOJOURNS:
        put(names, np.where((x >= first) & (x <= last), shapes[shape](*parameters), 0))
    return d


def categorical(values: list[str], groups: dict) -> Categorical:
    return Categorical(values, np.stack([by_state({k: v[i] for k, v in groups.items()}) for i in range(len(values))]))


def binary(groups: dict) -> Categorical:
    pos = by_state(groups)
    return Categorical(["pos", "neg"], np.stack((pos, 1 - pos)))


def cycle_model() -> Model:
    init = np.array([INIT.get(s, 1) for s in STATES], float)
    step = np.array([[TRANSITIONS[a].get(b, 0) for b in STATES] for a in STATES], float)
    emission = {
        "bleeding": categorical(BLEEDING, BLEEDING_PROBS), "mucus": categorical(MUCUS, MUCUS_PROBS), "temp": Normal(by_state(TEMP_MEAN), by_state(TEMP_SD)),
        "LH": binary(LH_POS), "preg": binary(PREG_POS),
    }
    return specify(STATES, init, step, sojourns(), emission, by_state(P_MISSING), {k: by_state(v) for k, v in Q_MISSING.items()})


def dedicated(model: Model) -> Model:
    """Missing-data probabilities of a user who reports nearly everything."""
    q = {k: v.copy() for k, v in model.q.items()}
    for k, groups in DEDICATED_Q.items():
        for names, value in groups.items():
            q[k][[STATES.index(n) for n in names.split()]] = value
    return replace(model, p=by_state(DEDICATED_P), q=q)


def with_effort(model: Model, effort: float) -> Model:
    """Missing-data probabilities for an effort in tracking from 0 (reports nothing) over 0.8 (as in ``model``) to 1 (reports all)."""

    def at(base: np.ndarray) -> np.ndarray:
        return np.array([float(np.clip(monotone_spline(np.array([0, 0.8, 1.0]), np.array([1.0, v, 0.0]), np.array([effort]))[0], 0, 1)) for v in base])

    return replace(model, p=at(model.p), q={k: at(v) for k, v in model.q.items()})


def bleeding_model(model: Model) -> Model:
    """The model with bleeding as its only variable."""
    return model.without([k for k in model.emission if k != "bleeding"])
