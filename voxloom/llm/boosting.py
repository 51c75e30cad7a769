"""Gradient-boosted trees for two classes, fitted in numpy on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Logistic loss, trees of fixed depth over quantile bins; scores are log-odds."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    start: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    #: For each tree: feature and bin of each inner node (heap order), value of each leaf.
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._binned(x)
        mean = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut, at = np.zeros(inner, np.int32), np.full(inner, self.bins + 1, np.int32), np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                local = at - first
                best = np.full(count, 1e-9)
                for k in range(x.shape[1]):
                    cell = local * (self.bins + 1) + b[:, k]
                    g = np.bincount(cell, grad, count * (self.bins + 1)).reshape(count, -1).cumsum(axis=1)
                    h = np.bincount(cell, hess, count * (self.bins + 1)).reshape(count, -1).cumsum(axis=1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    pos = gain.argmax(axis=1)
                    top = gain[np.arange(count), pos]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + count][better] = k
                    cut[first : first + count][better] = pos[better]
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + 1)
            self.nodes.append((feature, cut, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        if not len(x):
            return out
        b = self._binned(x)
        row = np.arange(len(x))
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[row, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out
