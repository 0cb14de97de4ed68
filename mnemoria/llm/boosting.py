"""Gradient-boosted trees for small labelled tables, kept as plain arrays so that tasks can score with them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 16


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth; node ``k`` has the children ``2k + 1`` and ``2k + 2``."""

    bias: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


def best_split(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
    best, found = 1e-9, (0, np.inf)
    total_g, total_h = gradient.sum(), hessian.sum()
    for k, thresholds in enumerate(cuts):
        for threshold in thresholds:
            right = x[:, k] > threshold
            g, h = gradient[right].sum(), hessian[right].sum()
            gain = g * g / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
            if gain > best:
                best, found = gain, (k, float(threshold))
    return found


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> Trees:
    """Logistic loss, second-order leaf values, splits at quantiles; the same data give the same trees."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    cuts = [np.unique(np.append(cut, x[:, k].min())) for k, cut in enumerate(cuts)]
    rate_of_ones = min(max(y.mean(), 1e-6), 1 - 1e-6)
    bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    score, inner = np.full(len(x), bias), 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(len(x), dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for k in range(inner):
            own = np.flatnonzero(node == k)
            if len(own) > 1:
                feature[k], threshold[k] = best_split(x[own], gradient[own], hessian[own], cuts)
            node[own] = 2 * k + 1 + (x[own, feature[k]] > threshold[k])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + 1)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(bias, np.array(features), np.array(thresholds), np.array(values), depth)
