"""Small gradient-boosted trees with calibrated scores, for models that are fitted on a bounded sample and applied inside tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic boosting of depth-limited trees on features cut at quantiles, then Platt scaling on rows held out from the trees."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    cuts: int = 16
    l2: float = 1.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    scale: tuple[float, float] = (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray, held: np.ndarray) -> BoostedTrees:
        """x: rows x features; y: 0 or 1; held: rows kept for calibration."""
        a, b = x[~held], y[~held]
        edges = [np.unique(np.quantile(a[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(a.shape[1])]
        score = np.zeros(len(a))
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._tree(a, b - p, p * (1 - p), edges)
            self.trees.append(tree)
            score += self._leaf(a, tree)
        self._calibrate(self._raw(x[held]), y[held])
        return self

    def _tree(self, x, gradient, hessian, edges):
        """A full binary tree in heap order: feature (-1: none), threshold and value of each node."""
        size = 2 ** (self.depth + 1) - 1
        feature, threshold, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(x), np.int64)
        for k in range(size):
            rows = np.flatnonzero(node == k)
            g, h = gradient[rows], hessian[rows]
            value[k] = self.rate * g.sum() / (h.sum() + self.l2)
            if k >= 2**self.depth - 1 or len(rows) < 8:
                continue
            best = (1e-6, -1, 0.0)
            whole = g.sum() ** 2 / (h.sum() + self.l2)
            for j, cuts in enumerate(edges):
                for t in cuts:
                    right = x[rows, j] > t
                    if 4 <= right.sum() <= len(rows) - 4:
                        gain = g[right].sum() ** 2 / (h[right].sum() + self.l2) + g[~right].sum() ** 2 / (h[~right].sum() + self.l2) - whole
                        best = max(best, (gain, j, t))
            if best[1] >= 0:
                feature[k], threshold[k] = best[1], best[2]
                node[rows] = 2 * k + 1 + (x[rows, best[1]] > best[2])
        return feature, threshold, value

    def _leaf(self, x, tree):
        feature, threshold, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            j = feature[node]
            node = np.where(j < 0, node, 2 * node + 1 + (x[np.arange(len(x)), j] > threshold[node]))
        return value[node]

    def _raw(self, x):
        return sum((self._leaf(x, t) for t in self.trees), np.zeros(len(x)))

    def _calibrate(self, raw, y):
        a, b = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):  # Newton steps on the logistic loss
            p = 1 / (1 + np.exp(-(a * raw + b)))
            w, d = p * (1 - p) + 1e-9, p - target
            h = np.array([[(w * raw * raw).sum() + 1e-6, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(h, [(d * raw).sum(), d.sum()])
            a, b = a - step[0], b - step[1]
            if np.abs(step).max() < 1e-9:
                break
        self.scale = (float(a), float(b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities."""
        return 1 / (1 + np.exp(-(self.scale[0] * self._raw(x) + self.scale[1])))


def lowest_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which the rows at or above it are right as often as asked; above 1 if there is none."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    last = np.append(p[order][1:] != p[order][:-1], True)  # only between different scores
    return float(p[order][np.flatnonzero(good & last)[-1]]) if (good & last).any() else 1.01
