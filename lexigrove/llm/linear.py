"""Sparse logistic regression, trained on the driver over a bounded sample: multinomial row by row, binary in small batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

Example = tuple[np.ndarray, np.ndarray, int]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[Example], classes: int, dims: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0, seed: int = 0) -> np.ndarray:
    """Weights (dims, classes) by follow-the-regularised-leader with elastic-net penalties. An example is (features, values, class)."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(examples)):
            f, v, y = examples[r]
            zi, ni = z[f], n[f]
            w = weights(zi, ni)
            p = _softmax(v @ w)
            p[y] -= 1.0
            g = v[:, None] * p
            g2 = g * g
            zi += g - (np.sqrt(ni + g2) - np.sqrt(ni)) / alpha * w
            z[f], n[f] = zi, ni + g2
    return weights(z, n)


@dataclass
class Rows:
    """Sparse rows end to end: features, values, and where each row begins (one more than there are)."""

    f: np.ndarray
    v: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, features: list[np.ndarray], weight: np.ndarray | None = None) -> Rows:
        f = np.concatenate([np.empty(0, np.int64), *features]).astype(np.int64)
        return cls(f, np.ones(len(f)) if weight is None else weight[f], np.cumsum([0, *(len(x) for x in features)]))

    def take(self, rows: np.ndarray) -> Rows:
        size = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(size)
        pick = np.repeat(self.at[rows] - (ends - size), size) + np.arange(int(size.sum()))
        return Rows(self.f[pick], self.v[pick], np.concatenate([[0], ends]))

    def marks(self, w: np.ndarray) -> np.ndarray:
        n = len(self.at) - 1
        return np.bincount(np.repeat(np.arange(n), np.diff(self.at)), self.v * w[self.f], n)


def binary(rows: Rows, y: np.ndarray, dims: int, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.5, batch: int = 32, seed: int = 0) -> np.ndarray:
    """Weights (dims) of the log odds by follow-the-regularised-leader, a step for each small batch; an epoch has 64 steps at least where there are as many rows."""
    z, n, batch = np.zeros(dims), np.zeros(dims), max(1, min(batch, len(y) // 64))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        perm = order.permutation(len(y))
        mixed, target = rows.take(perm), y[perm]
        for i in range(0, len(y), batch):
            j = min(i + batch, len(y))
            a, b = mixed.at[i], mixed.at[j]
            u, place = np.unique(mixed.f[a:b], return_inverse=True)
            r, v = np.repeat(np.arange(j - i), np.diff(mixed.at[i : j + 1])), mixed.v[a:b]
            zi, ni = z[u], n[u]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(r, w[place] * v, j - i), -30, 30)))
            g = np.bincount(place, (p - target[i:j])[r] * v, len(u))
            z[u], n[u] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w, ni + g * g
    return weights(z, n)


def logits(examples: list[Example], w: np.ndarray) -> np.ndarray:
    return np.array([v @ w[f] for f, v, _ in examples]).reshape(len(examples), w.shape[1])


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) is calibrated, by Newton steps on smoothed targets."""
    up, down = int(y.sum()), int(len(y) - y.sum())
    if not up or not down:
        return 0.0, float(np.log((up + 1) / (down + 1)))
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    scale = float(np.abs(scores).mean()) or 1.0
    x = np.stack([scores / scale, np.ones(len(scores))], axis=1)
    w = np.array([1.0, np.log((up + 1) / (down + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - t) + 1e-3 * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / scale), float(w[1])
