"""Gradient-boosted trees on binned features, for small training sets, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Logistic gradient boosting; trees of fixed depth, histogram splits."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.15, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        codes = self._codes(x)
        width = self.bins + 1
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(n, self.start)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.rounds):
            p = _sigmoid(score)
            g, h = y - p, p * (1 - p)
            inner = 2**self.depth - 1
            feature, cut, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, width, dtype=np.int64), np.zeros(2**self.depth)
            node = np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                k = 2**level
                best = np.full(k, 1e-6)
                for j in range(f):
                    at = (node - first) * width + codes[:, j]
                    gs = np.bincount(at, g, k * width).reshape(k, width).cumsum(axis=1)
                    hs = np.bincount(at, h, k * width).reshape(k, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    b = gain.argmax(axis=1)
                    v = gain[np.arange(k), b]
                    up = v > best
                    best[up], feature[first + np.flatnonzero(up)], cut[first + np.flatnonzero(up)] = v[up], j, b[up]
                node = 2 * node + 1 + (codes[np.arange(n), feature[node]] > cut[node])
            at = node - inner
            leaf = self.rate * np.bincount(at, g, len(leaf)) / (np.bincount(at, h, len(leaf)) + self.ridge)
            score += leaf[at]
            self.trees.append((feature, cut, leaf))
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes, rows = self._codes(x), np.arange(len(x))
        score = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (codes[rows, feature[node]] > cut[node])
            score += leaf[node - len(feature)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200, prior: float = 4.0) -> BoostedTrees:
        """Platt scaling of the margin on a holdout, with smoothed targets and a pull of weight ``prior`` to the identity."""
        m = self.margin(x)
        pos, neg = y.sum(), (1 - y).sum()
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = _sigmoid(a * m + b)
            d, w = target - p, p * (1 - p) + 1e-6
            grad = np.array([(d * m).sum() - prior * (a - 1), d.sum() - prior * b])
            hess = np.array([[(w * m * m).sum() + prior, (w * m).sum()], [(w * m).sum(), w.sum() + prior]])
            step = np.linalg.solve(hess, grad)
            a, b = a + step[0] / 2, b + step[1] / 2
            if np.abs(step).max() < 1e-6:
                break
        if a > 0:
            self.scale, self.shift = float(a), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * self.margin(x) + self.shift)
