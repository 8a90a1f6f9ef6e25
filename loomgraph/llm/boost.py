"""Gradient-boosted trees for two classes, in numpy: histogram splits, logistic loss, fixed depth."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Complete trees of one depth. A row goes right where its value is above the split's."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, least: float = 4.0, penalty: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.penalty = trees, depth, rate, bins, least, penalty
        self.feature = np.zeros((0, 0), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.split = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(n, self.start)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                width, first = 1 << level, (1 << level) - 1
                best = np.full(width, 1e-6)
                for j in range(m):
                    if not len(edges[j]):
                        continue
                    size = len(edges[j]) + 1
                    at = node * size + binned[:, j]
                    g = np.bincount(at, grad, width * size).reshape(width, size).cumsum(1)
                    h = np.bincount(at, hess, width * size).reshape(width, size).cumsum(1)
                    gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hl < self.least / 4) | (ht - hl < self.least / 4)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best = np.where(better, top, best)
                    self.feature[t, first : first + width] = np.where(better, j, self.feature[t, first : first + width])
                    self.split[t, first : first + width] = np.where(better, edges[j][k], self.split[t, first : first + width])
                here = first + node
                node = 2 * node + (x[np.arange(n), self.feature[t, here]] > self.split[t, here])
            g, h = np.bincount(node, grad, inner + 1), np.bincount(node, hess, inner + 1)
            self.leaf[t] = self.rate * g / (h + self.penalty)
            score += self.leaf[t, node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        score, rows = np.full(len(x), self.start), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = (1 << level) - 1 + node
                node = 2 * node + (x[rows, self.feature[t, here]] > self.split[t, here])
            score += self.leaf[t, node]
        return 1 / (1 + np.exp(-score))
