"""Gradient-boosted trees for two classes, in numpy: quantile bins, histogram splits, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of one depth: node i has children 2i + 1 and 2i + 2; values are at the leaves."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # goes right if greater
    value: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.value.shape[1]))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += value[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> Trees:
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)])  # x > edges[b] is bin > b
    rate_0 = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate_0 / (1 - rate_0)))
    margin, inner, leaves = np.full(n, base), 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = at - first
            g_all, h_all = np.bincount(local, grad, width), np.bincount(local, hess, width)
            for j in range(d):
                m = len(edges[j]) + 1
                if m < 2:
                    continue
                key = local * m + binned[j]
                g = np.cumsum(np.bincount(key, grad, width * m).reshape(width, m), 1)[:, :-1]
                h = np.cumsum(np.bincount(key, hess, width * m).reshape(width, m), 1)[:, :-1]
                g2, h2 = g_all[:, None] - g, h_all[:, None] - h
                gain = g * g / (h + l2) + g2 * g2 / (h2 + l2) - (g_all**2 / (h_all + l2))[:, None]
                gain[(h < 1) | (h2 < 1)] = -1
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                features[t, first : first + width][better] = j
                thresholds[t, first : first + width][better] = edges[j][k[better]]
            at = 2 * at + 1 + (x[np.arange(n), features[t, at]] > thresholds[t, at])
        leaf = at - inner
        values[t] = rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + l2)
        margin += values[t, leaf]
    return Trees(features, thresholds, values, base)
