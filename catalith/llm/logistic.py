"""Logistic regression over sparse rows, in numpy, for bounded labelled samples."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows as one index and one value array."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int):
        self.n, self.width = len(rows), width
        self.idx = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.int32)
        self.val = np.concatenate([r[1] for r in rows]) if rows else np.empty(0, np.float32)
        self.row = np.repeat(np.arange(self.n), [len(r[0]) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.idx], minlength=self.n)

    def dot_t(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.idx, weights=self.val * g[self.row], minlength=self.width)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-4, steps: int = 60) -> tuple[np.ndarray, float]:
    """Weights and intercept by gradient descent with Nesterov momentum on the mean log loss."""
    weight = np.ones(rows.n) if weight is None else weight
    weight = weight / max(weight.sum(), 1e-9)
    w, b = np.zeros(rows.width), 0.0
    vw, vb, rate = np.zeros(rows.width), 0.0, 8.0
    for t in range(steps):
        momentum = t / (t + 3)
        aw, ab = w + momentum * vw, b + momentum * vb
        g = (sigmoid(rows.dot(aw) + ab) - y) * weight
        nw, nb = aw - rate * (rows.dot_t(g) + l2 * aw), ab - rate * 0.25 * g.sum()
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) so that sigmoid(slope * z + shift) is calibrated; Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    p = np.array([1.0, 0.0])
    for _ in range(steps):
        s = sigmoid(x @ p)
        hess = (x * (s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (s - t) + 1e-3 * (p - [1.0, 0.0]))
        p = p - np.clip(step, -2, 2)
    return float(p[0]), float(p[1])
