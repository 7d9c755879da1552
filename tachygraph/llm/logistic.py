"""Logistic models on the driver: small matrices of a bounded sample."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights (the last one is the constant), by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_above(x: np.ndarray, y: np.ndarray, least: np.ndarray, ridge: float = 1e-2, cycles: int = 500) -> np.ndarray:
    """The same with a least value for each weight but the constant's, by Newton steps for one weight at a time."""
    x = np.hstack([x, np.ones((len(x), 1))])
    least = np.append(least, -np.inf)
    w = np.maximum(np.zeros(len(least)), least)
    z = x @ w
    for _ in range(cycles):
        moved = 0.0
        for k in range(len(w)):
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            slope = x[:, k] @ (p - y) + ridge * w[k]
            curve = (x[:, k] ** 2 * p * (1 - p)).sum() + ridge
            new = max(least[k], w[k] - float(np.clip(slope / curve, -2, 2)))
            z += x[:, k] * (new - w[k])
            moved, w[k] = max(moved, abs(new - w[k])), new
        if moved < 1e-4:
            break
    return w
