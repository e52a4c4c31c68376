"""Gradient-boosted trees over binned dense features, and isotonic regression, in numpy."""

from __future__ import annotations

import numpy as np


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ascending knots and the least-squares non-decreasing values there. Equal x are one knot."""
    knots, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back).astype(float)
    value = np.bincount(back, weights=y) / weight
    pools: list[list[float]] = []  # value, weight, knots
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return knots, np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


class Trees:
    """Logistic loss, second-order leaves, trees grown by level to one depth."""

    def __init__(self, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias, self.knots, self.values = 0.0, np.array([0.0]), np.array([0.0])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        n, f = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(rate / (1 - rate)))
        z = np.full(n, self.bias)
        width = self.bins + 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            feature, cut = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                gain, best, at = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
                for j in range(f):
                    key = node * width + binned[:, j]
                    gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(axis=1)
                    hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    s = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    s[(hs < self.least * 0.25) | (ht - hs < self.least * 0.25)] = 0
                    k = s[:, :-1].argmax(axis=1)
                    v = s[np.arange(count), k]
                    better = v > gain + 1e-9
                    gain, best, at = np.where(better, v, gain), np.where(better, j, best), np.where(better, k, at)
                right = np.zeros(n, np.int64)
                for c in range(count):
                    j = best[c]
                    if j >= 0 and at[c] < len(self.edges[j]):
                        feature[first + c], cut[first + c] = j, self.edges[j][at[c]]
                        own = node == c
                        right[own] = binned[own, j] > at[c]
                node = node * 2 + right
            leaves = 2**self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.l2)
            self.trees.append((feature, cut, value))
            z += value[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                j = feature[at]
                node = node * 2 + ((j >= 0) & (x[rows, np.maximum(j, 0)] >= cut[at]))
            z += value[node]
        return z

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.knots, self.values = isotonic(self.margin(x), y)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; straight lines between knots keep it non-decreasing in the margin."""
        return np.clip(np.interp(self.margin(x), self.knots, self.values), 0.0, 1.0)
