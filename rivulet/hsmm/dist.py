"""Discrete durations and densities, in NumPy alone."""

from __future__ import annotations

import math

import numpy as np


def normalised(d: np.ndarray) -> np.ndarray:
    total = d.sum()
    if not total > 0:
        raise ValueError("a distribution needs some weight")
    return d / total


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in np.ravel(x)]).reshape(np.shape(x))


def gamma(n: int, shape: float, scale: float) -> np.ndarray:
    """Weights of 1..n from the density at these days."""
    x = np.arange(1, n + 1, dtype=float)
    return np.exp((shape - 1) * np.log(x) - x / scale - math.lgamma(shape) - shape * math.log(scale))


def geometric(n: int, prob: float) -> np.ndarray:
    return prob * (1 - prob) ** np.arange(n)


def poisson(n: int, rate: float, shift: int = 1) -> np.ndarray:
    k = np.arange(1, n + 1) - shift
    return np.where(k >= 0, np.exp(np.maximum(k, 0) * math.log(rate) - rate - _lgamma(np.maximum(k, 0) + 1.0)), 0.0)


def negative_binomial(n: int, size: float, prob: float, shift: int = 1) -> np.ndarray:
    k = np.maximum(np.arange(1, n + 1) - shift, 0)
    d = np.exp(_lgamma(k + size) - math.lgamma(size) - _lgamma(k + 1.0) + size * math.log(prob) + k * math.log1p(-prob))
    return np.where(np.arange(1, n + 1) >= shift, d, 0.0)


def log_normal(n: int, mean: float, sd: float) -> np.ndarray:
    x = np.arange(1, n + 1, dtype=float)
    return np.exp(-0.5 * ((np.log(x) - mean) / sd) ** 2) / (x * sd * math.sqrt(2 * math.pi))


def logarithmic(n: int, prob: float) -> np.ndarray:
    k = np.arange(1, n + 1)
    return -(prob**k) / (k * math.log1p(-prob))


def normal(x: np.ndarray, mean, sd) -> np.ndarray:
    return np.exp(-0.5 * ((x - mean) / sd) ** 2) / (np.asarray(sd) * math.sqrt(2 * math.pi))


def skew_normal(x: np.ndarray, place: float, scale: float, skew: float) -> np.ndarray:
    z = (x - place) / scale
    below = np.array([0.5 * (1 + math.erf(skew * v / math.sqrt(2))) for v in z])
    return 2 / scale * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) * below


def fit_gamma(x: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted maximum likelihood of shape and scale, by Newton steps on the shape."""
    keep = weight > 0
    x, weight = x[keep], weight[keep] / weight[keep].sum()
    mean = float((weight * x).sum())
    s = math.log(mean) - float((weight * np.log(x)).sum())
    if s <= 1e-9:
        return 1e4, mean / 1e4
    shape = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(30):
        step = (math.log(shape) - digamma(shape) - s) / (1 / shape - trigamma(shape))
        shape = max(shape - step, shape / 2)
        if abs(step) < 1e-10 * shape:
            break
    return shape, mean / shape


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y / 252))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y / 42))


def smooth(d: np.ndarray, bandwidth: float | None = None) -> np.ndarray:
    """A Gaussian kernel density of durations with weights d."""
    x = np.arange(1, len(d) + 1, dtype=float)
    w = normalised(d)
    if bandwidth is None:
        mean = (w * x).sum()
        sd = math.sqrt(max((w * (x - mean) ** 2).sum(), 1e-12))
        bandwidth = max(0.9 * sd * max(1 / (w**2).sum(), 1.0) ** -0.2, 0.2)
    used = np.flatnonzero(w)
    return normalised((w[used] * normal(x[:, None], x[used], bandwidth)).sum(axis=1))


def monotone_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A cubic Hermite curve through the points that rises and falls only where they do (after Fritsch and Carlson)."""
    h, slope = np.diff(x), np.diff(y) / np.diff(x)
    m = np.concatenate(([slope[0]], (slope[:-1] + slope[1:]) / 2, [slope[-1]]))
    for k, s in enumerate(slope):
        if s == 0:
            m[k] = m[k + 1] = 0
            continue
        a, b = m[k] / s, m[k + 1] / s
        m[k], m[k + 1] = (0 if a < 0 else m[k]), (0 if b < 0 else m[k + 1])
        if (r := math.hypot(max(a, 0), max(b, 0))) > 3:
            m[k], m[k + 1] = 3 / r * max(a, 0) * s, 3 / r * max(b, 0) * s
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(h) - 1)
    u = (at - x[k]) / h[k]
    return (1 + 2 * u) * (1 - u) ** 2 * y[k] + u * (1 - u) ** 2 * h[k] * m[k] + u * u * (3 - 2 * u) * y[k + 1] + u * u * (u - 1) * h[k] * m[k + 1]
