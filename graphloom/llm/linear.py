"""A small logistic regression over sparse rows, shared by the text classifiers; fitted on the driver on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Rows:
    """Sparse 0/1 rows: column numbers of all rows in a line, and where each row begins."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.columns = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        self.owner = np.repeat(np.arange(self.n), [len(r) for r in rows]) if rows else np.empty(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.columns], self.n) if self.n else np.empty(0)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.columns, g[self.owner], width) if self.n else np.zeros(width)


def fit(rows: Rows, y: np.ndarray, width: int, l2: float, steps: int = 120, pairs: tuple[Rows, Rows] | None = None, pair_weight: float = 0.0, counts: np.ndarray | None = None, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression by Adam on the whole sample.

    ``pairs``: rows that must score alike; the mean squared difference of their linear scores, times ``pair_weight``, is
    added to the loss; each counts as many times as ``counts`` says. Classes are weighted equally.
    """
    w, b = np.zeros(width), 0.0
    if not rows.n:
        return w, b
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    if pairs and pairs[0].n:
        share = np.full(pairs[0].n, 1 / pairs[0].n) if counts is None else counts / counts.sum()
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    for t in range(1, steps + 1):
        g = (sigmoid(rows.dot(w) + b) - y) * weight
        grad, grad_b = rows.back(g, width) + l2 * w, g.sum()
        if pairs and pairs[0].n:
            d = (pairs[0].dot(w) - pairs[1].dot(w)) * share * (2 * pair_weight)
            grad += pairs[0].back(d, width) - pairs[1].back(d, width)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_b, 0.99 * vb + 0.01 * grad_b * grad_b
        step = rate * (1 - t / (steps + 1))
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, b
