"""Gradient-boosted trees for small, bounded training samples, in numpy.

``fit`` runs on the driver over a sample whose size is a documented parameter of the caller; the model is
a few hundred numbers that travel with the task, and ``score`` is vectorised over rows.
"""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting with depth-limited regression trees on binned features."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 2.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree: list[tuple[int, int, float]] = [(-1, 0, 0.0)] * (2 ** (self.depth + 1))
            self._grow(tree, 1, codes, y - p, p * (1 - p), np.arange(len(y)), 0)
            tree = tuple(np.array(c) for c in zip(*tree))
            self.trees.append(tree)
            score += self.rate * self._walk(tree, codes)
        return self

    def _grow(self, tree, node, codes, g, h, rows, level):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        tree[node] = (-1, 0, float(total_g / (total_h + 1.0)))
        if level == self.depth or len(rows) < 4:
            return
        best, split = 1e-6, None
        for j in range(codes.shape[1]):
            n = len(self.cuts[j]) + 1
            if n < 2:
                continue
            left_g = np.cumsum(np.bincount(codes[rows, j], g[rows], n))[:-1]
            left_h = np.cumsum(np.bincount(codes[rows, j], h[rows], n))[:-1]
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - total_g**2 / (total_h + 1)
            gain[(left_h < self.least / 4) | (right_h < self.least / 4)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, split = gain[k], (j, k)
        if split is None:
            return
        j, k = split
        tree[node] = (j, k, tree[node][2])
        low = codes[rows, j] <= k
        self._grow(tree, 2 * node, codes, g, h, rows[low], level + 1)
        self._grow(tree, 2 * node + 1, codes, g, h, rows[~low], level + 1)

    @staticmethod
    def _walk(tree, codes):
        feature, cut, value = tree
        node = np.ones(len(codes), np.int64)
        while True:
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                return value[node]
            at = np.flatnonzero(inner)
            node[at] = 2 * node[at] + (codes[at, f[at]] > cut[node[at]])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class for each row."""
        if not len(x):
            return np.zeros(0)
        codes = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], 1)
        total = np.full(len(x), self.base)
        for tree in self.trees:
            total += self.rate * self._walk(tree, codes)
        return 1 / (1 + np.exp(-total))


def threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """Lowest score from which held-out precision stays at ``precision``; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order])
    share = right / np.arange(1, len(y) + 1)
    ends = np.append(score[order][1:] < score[order][:-1], True) if len(y) else np.zeros(0, bool)
    good = np.flatnonzero((share >= precision) & ends)
    return float(score[order][good[-1]]) if len(good) and right[good[-1]] >= 10 else 2.0
