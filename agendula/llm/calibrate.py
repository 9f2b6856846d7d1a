"""A small logistic regression for calibrating scores."""

from __future__ import annotations

import numpy as np


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (bias first) by Newton's method; without both classes the bias is the smoothed log odds."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ones = float(y.sum())
    w[0] = np.log((ones + 0.5) / (len(y) - ones + 0.5))
    if 0 < ones < len(y):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
            step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))
