"""Small linear models in numpy: logistic regression and squared-hinge support vector machines, both by accelerated gradient descent."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Rows:
    """Sparse rows (row and column index of each entry, value 1) times vectors."""

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.shape = row, col, shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.shape[1])


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, self.shape = x, x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.x.T @ g


def fit(x, y: np.ndarray, loss: str, l2: float, scale: np.ndarray | None = None, steps: int = 300, rate: float | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias for y in {-1, 1}. scale multiplies each feature. The bias is not penalised."""
    scale = np.ones(x.shape[1]) if scale is None else scale
    w, b = np.zeros(x.shape[1]), 0.0
    vw, vb = w.copy(), b
    n = len(y)
    if rate is None:  # from the largest curvature, by power iteration
        v = np.random.default_rng(0).normal(size=x.shape[1])
        for _ in range(12):
            v = scale * x.back(x.dot(scale * v))
            v /= np.linalg.norm(v) + 1e-30
        top = np.linalg.norm(scale * x.back(x.dot(scale * v))) / n + 1
        rate = 1 / (top * (0.25 if loss == "log" else 2.0) + l2)
    for k in range(steps):
        z = x.dot(scale * vw) + vb
        if loss == "log":
            g = -y * sigmoid(-y * z) / n
        else:
            g = -2 * y * np.maximum(0, 1 - y * z) / n
        nw, nb = vw - rate * (scale * x.back(g) + l2 * vw), vb - rate * g.sum()
        m = k / (k + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return w * scale, b
