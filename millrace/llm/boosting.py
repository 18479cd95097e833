"""Histogram gradient-boosted trees in numpy, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Forest:
    """Complete trees of one depth: inner nodes in heap order, then leaves; ``x > threshold`` goes right."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 per row; all rows go down a tree together."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return sigmoid(total)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: int = 10) -> Forest:
    """Fit by Newton steps on the logistic loss over binned features.

    Without rows the forest is empty and scores 0.5; with one class it scores the smoothed share.
    """
    n, k = x.shape
    inner = (1 << depth) - 1
    share = (y.sum() + 1) / (n + 2)
    forest = Forest(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if n < 2 * least or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(k)])
    total = np.full(n, forest.base)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = sigmoid(total)
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            local = node - first
            best = np.zeros(width)
            for j in range(k):
                at = local * bins + binned[:, j]
                sums = [np.bincount(at, w, width * bins).reshape(width, bins) for w in (g, h, np.ones(n))]
                left = [np.cumsum(s, 1)[:, : len(edges[j])] for s in sums]
                if not left[0].shape[1]:
                    continue
                whole = [s.sum(1, keepdims=True) for s in sums]
                gain = left[0] ** 2 / (left[1] + l2) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
                gain[(left[2] < least) | (whole[2] - left[2] < least)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                for i in np.flatnonzero(value > best + 1e-9):
                    best[i], feature[first + i], threshold[first + i] = value[i], j, edges[j][top[i]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        at = node - inner
        leaf = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        total += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(forest.base, np.array(features), np.array(thresholds), np.array(leaves))
