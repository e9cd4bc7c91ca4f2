"""Linear models fitted on a bounded, already collected sample with numpy."""

from __future__ import annotations

import numpy as np


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Linear support vector machine in the primal: squared hinge loss, accelerated gradient. ``y`` is -1 or 1; the last entry is the bias."""
    return _descend(x, y, weight, l2, steps, lambda m: np.maximum(0, 1 - m) * -2, 2.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression by the same descent; ``y`` is -1 or 1; the last entry is the bias."""
    return _descend(x, y, weight, l2, steps, lambda m: -1 / (1 + np.exp(np.clip(m, -30, 30))), 0.25)


def _descend(x, y, weight, l2, steps, slope, curvature) -> np.ndarray:
    weight = np.full(len(x), 1 / max(len(x), 1)) if weight is None else weight / weight.sum()
    # The largest eigenvalue of the weighted Gram matrix bounds the curvature.
    times = lambda v: x @ v[:-1] + v[-1]  # noqa: E731  the bias column is not stored
    back = lambda u: np.append(u @ x, u.sum()).astype(x.dtype)
    v = np.random.default_rng(0).standard_normal(x.shape[1] + 1).astype(x.dtype)
    top = 1.0
    for _ in range(20):
        u = back(weight.astype(x.dtype) * times(v))
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    rate = 1 / (1.1 * curvature * top + l2)
    w = z = np.zeros(x.shape[1] + 1, x.dtype)
    t = 1.0
    for _ in range(steps):
        g = back((weight * slope(y * times(z)) * y).astype(x.dtype)) + l2 * np.append(z[:-1], 0).astype(x.dtype)
        new = z - rate * g
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w.astype(np.float64)


def balanced(y: np.ndarray) -> np.ndarray:
    """Row weights that give both signs the same share."""
    out = np.zeros(len(y))
    for s in (-1, 1):
        if (y == s).any():
            out[y == s] = 0.5 / (y == s).sum()
    return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
