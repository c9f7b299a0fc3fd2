"""Gradient-boosted trees in numpy."""

from __future__ import annotations

import numpy as np


class Boosting:
    """Logistic gradient boosting of depth-limited trees on quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24):
        self.n_trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        q = self._binned(x)
        columns = np.ascontiguousarray(q.T)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.start)
        nodes = 1 << self.depth
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, self.bins + 1)
            at = np.ones(len(y), np.int64)
            for level in range(self.depth):
                for node in range(1 << level, 2 << level):
                    rows = np.flatnonzero(at == node)
                    if len(rows) >= 10:
                        best = 1e-4
                        gr, hr = g[rows], h[rows]
                        gs, hs = gr.sum(), hr.sum()
                        for j, column in enumerate(columns):
                            binned = column[rows]
                            gl = np.cumsum(np.bincount(binned, gr, self.bins + 1))[:-1]
                            hl = np.cumsum(np.bincount(binned, hr, self.bins + 1))[:-1]
                            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                            k = int(gain.argmax())
                            if gain[k] > best:
                                best, feature[node], cut[node] = gain[k], j, k
                at = 2 * at + (q[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - nodes
            value = self.rate * np.bincount(leaf, g, nodes) / (np.bincount(leaf, h, nodes) + 1)
            self.trees.append((feature, cut, value))
            z += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        q, z = self._binned(x), np.full(len(x), self.start)
        for feature, cut, value in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (q[np.arange(len(x)), feature[at]] > cut[at])
            z += value[at - len(value)]
        return 1 / (1 + np.exp(-z))
