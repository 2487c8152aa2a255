"""Gradient-boosted trees for two classes, on features cut into bins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Per tree: feature and threshold of every inner node, in heap order, and the value of every leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the rows."""
        depth = int(np.log2(self.value.shape[1]))
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 32, penalty: float = 1.0, share: float = 0.4, seed: int = 1) -> Trees:
    """Newton boosting of the logistic loss; every level splits each node at the best of `bins` quantiles of a feature.

    Each tree sees a drawn share of the features, so that none can stand for all others.
    """
    n, total = x.shape
    features, draw = max(1, round(share * total)), np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(total)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    positive = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(positive / (1 - positive)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    all_feature, all_threshold, all_value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        seen = np.sort(draw.choice(total, features, replace=False))
        flat = binned[:, seen] + np.arange(features) * bins
        p = 1 / (1 + np.exp(-score))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            keys = ((node - first)[:, None] * (features * bins) + flat).ravel()
            g = np.bincount(keys, np.repeat(slope, features), count * features * bins).reshape(count, features, bins).cumsum(axis=2)
            h = np.bincount(keys, np.repeat(bend, features), count * features * bins).reshape(count, features, bins).cumsum(axis=2)
            gs, hs = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + penalty) + (gs - g) ** 2 / (hs - h + penalty) - gs**2 / (hs + penalty)
            gain[(h < 1e-3) | (hs - h < 1e-3)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            f, b = seen[best // bins], best % bins
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-6
            limit = np.array([cuts[a][c] if ok and c < len(cuts[a]) else np.inf for a, c, ok in zip(f, b, good, strict=True)])
            all_feature[t, first:first + count], all_threshold[t, first:first + count] = f, limit
            here = node - first
            node = 2 * node + 1 + (x[np.arange(n), f[here]] > limit[here])
        leaf = node - inner
        value = -np.bincount(leaf, slope, leaves) / (np.bincount(leaf, bend, leaves) + penalty) * rate
        all_value[t] = value
        score += value[leaf]
    return Trees(all_feature, all_threshold, all_value, base)
