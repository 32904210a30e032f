"""Gradient-boosted trees for a yes/no target, in numpy: logistic loss, quantile bins, trees of one depth."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees: at every inner place a feature and a threshold, at every leaf a step of the log-odds."""

    depth: int
    start: float = 0.0
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            place = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (x[every, feature[place]] > threshold[place])
            out += leaf[place - len(feature)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weights: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> BoostedTrees:
    """Newton boosting on binned features; a place that can't be split sends all to its left."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    share = float(np.clip((weights * y).sum() / weights.sum(), 1e-6, 1 - 1e-6))
    model = BoostedTrees(depth, float(np.log(share / (1 - share))))
    score = np.full(len(y), model.start)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = weights * (y - p), weights * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        place = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            local = place - first
            gain = np.full(width, 1e-9)
            g_all, h_all = np.bincount(local, grad, width), np.bincount(local, hess, width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * (len(c) + 1) + binned[:, j]
                g = np.bincount(key, grad, width * (len(c) + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                h = np.bincount(key, hess, width * (len(c) + 1)).reshape(width, -1).cumsum(axis=1)[:, :-1]
                rest_g, rest_h = g_all[:, None] - g, h_all[:, None] - h
                value = g * g / (h + ridge) + rest_g * rest_g / (rest_h + ridge) - (g_all * g_all / (h_all + ridge))[:, None]
                value = np.where((h >= least) & (rest_h >= least), value, -np.inf)
                best = value.argmax(axis=1)
                top = value[np.arange(width), best]
                better = top > gain
                gain = np.where(better, top, gain)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
                threshold[first : first + width] = np.where(better, c[best], threshold[first : first + width])
            place = 2 * place + 1 + (x[np.arange(len(y)), feature[place]] > threshold[place])
        leaf = place - inner
        step = rate * np.bincount(leaf, grad, 2**depth) / (np.bincount(leaf, hess, 2**depth) + ridge)
        score += step[leaf]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.leaves.append(step)
    return model
