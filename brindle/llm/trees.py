"""Gradient-boosted trees and logistic calibration in numpy, for small bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Binary classifier: regression trees on binned features, fitted to logistic loss.

    Bins are quantiles, so a mark that few rows bear has no bin of its own; with ``rare``
    every value of a feature that has at most ``bins`` values gets one.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, rare: bool = False):
        self.rare = rare
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.bias = 0.0

    def _binned(self, X: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, X[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, X: np.ndarray, y: np.ndarray) -> BoostedTrees:
        X, y = np.asarray(X, np.float64), np.asarray(y, np.float64)
        self.edges = [self._cuts(X[:, j]) if len(X) else np.zeros(0) for j in range(X.shape[1])]
        self.trees = []
        mean = (y.sum() + 0.5) / (len(y) + 1.0)
        self.bias = float(np.log(mean / (1 - mean)))
        if not len(y) or y.min() == y.max():
            return self
        B = self._binned(X)
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree = self._grow(B, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._walk(B, tree)
        return self

    def _cuts(self, x: np.ndarray) -> np.ndarray:
        if self.rare and len(values := np.unique(x)) <= self.bins:
            return values[1:]
        return np.unique(np.quantile(x, np.linspace(0, 1, self.bins + 1)[1:-1]))

    def _grow(self, B: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete tree of ``depth`` levels: feature and bin of inner nodes, values of leaves."""
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 1 << 30)
        node = np.zeros(len(g), np.int64)
        width = self.bins + 1
        for level in range(self.depth):
            first, count = (1 << level) - 1, 1 << level
            best = np.zeros(count)
            for j in range(B.shape[1]):
                at = (node - first) * width + B[:, j]
                G = np.bincount(at, g, count * width).reshape(count, width).cumsum(1)
                H = np.bincount(at, h, count * width).reshape(count, width).cumsum(1)
                total_g, total_h = G[:, -1:], H[:, -1:]
                gain = G**2 / (H + self.ridge) + (total_g - G) ** 2 / (total_h - H + self.ridge) - total_g**2 / (total_h + self.ridge)
                k = gain[:, :-1].argmax(1)
                v = gain[np.arange(count), k]
                better = v > best + 1e-9
                best = np.where(better, v, best)
                feature[first : first + count][better] = j
                cut[first : first + count][better] = k[better]
            node = 2 * node + 1 + (B[np.arange(len(B)), feature[node]] > cut[node])
        leaf = node - inner
        n = 1 << self.depth
        value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
        return feature, cut, value

    def _walk(self, B: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, cut, value = tree
        node, rows = np.zeros(len(B), np.int64), np.arange(len(B))
        for _ in range(self.depth):
            node = 2 * node + 1 + (B[rows, feature[node]] > cut[node])
        return value[node - len(feature)]

    def margin(self, X: np.ndarray) -> np.ndarray:
        X = np.asarray(X, np.float64)
        out = np.full(len(X), self.bias)
        if self.trees:
            B = self._binned(X)
            for tree in self.trees:
                out += self._walk(B, tree)
        return out

    def predict(self, X: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(X))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of calibrated probabilities sigmoid(a * margin + b), by Newton steps."""
    a, b = 1.0, 0.0
    y = np.asarray(y, np.float64)
    if len(y) < 10 or y.min() == y.max():
        return a, b
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    X = np.stack([margin, np.ones(len(margin))], 1)
    w = np.array([a, b])
    for _ in range(steps):
        p = sigmoid(X @ w)
        grad = X.T @ (p - t) + 1e-3 * (w - np.array([1.0, 0.0]))
        hess = (X * (p * (1 - p))[:, None]).T @ X + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])
