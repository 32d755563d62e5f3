"""A small decision tree (CART, Gini) in numpy, for classifiers trained on labelled tables of a few thousand rows."""

from __future__ import annotations

import numpy as np


class Tree:
    """Binary classifier; node arrays, so that it is cheap to send and applies to many rows at once."""

    def __init__(self, depth: int = 10, leaf: int = 3):
        self.depth, self.leaf = depth, leaf
        self.feature: list[int] = []
        self.at: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(np.asarray(x, float), np.asarray(y, float), 0)
        self.nodes = tuple(np.array(v) for v in (self.feature, self.at, self.left, self.right, self.value))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int) -> int:
        k = len(self.feature)
        for part, v in ((self.feature, -1), (self.at, 0.0), (self.left, k), (self.right, k), (self.value, float(y.mean()) if len(y) else 0.0)):
            part.append(v)
        if level >= self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return k
        best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        n = np.arange(1, len(y))
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            ok = (v[1:] > v[:-1]) & (n >= self.leaf) & (len(y) - n >= self.leaf)
            if not ok.any():
                continue
            a, b = ones[:-1], ones[-1] - ones[:-1]
            impurity = np.where(ok, a * (1 - a / n) + b * (1 - b / (len(y) - n)), np.inf)
            i = int(impurity.argmin())
            if impurity[i] < best[0]:
                best = (float(impurity[i]), f, float(v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return k
        self.feature[k], self.at[k] = best[1], best[2]
        go = x[:, best[1]] <= best[2]
        self.left[k] = self._grow(x[go], y[go], level + 1)
        self.right[k] = self._grow(x[~go], y[~go], level + 1)
        return k

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of positive rows in each row's leaf."""
        feature, at, left, right, value = self.nodes
        node = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(self.depth + 1):
            f = feature[node]
            go = x[rows, np.maximum(f, 0)] <= at[node]
            node = np.where(f < 0, node, np.where(go, left[node], right[node]))
        return value[node]
