"""Gradient-boosted trees for a few classes, trained on a bounded sample, and calibration of one probability."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: list[int] = field(default_factory=list)
    bound: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def node(self) -> int:
        for col, v in ((self.feature, -1), (self.bound, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            col.append(v)
        return len(self.feature) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        f, b, lo, hi, v = (np.array(c) for c in (self.feature, self.bound, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        while True:
            inner = f[at] >= 0
            if not inner.any():
                return v[at]
            rows = np.flatnonzero(inner)
            k = at[rows]
            at[rows] = np.where(x[rows, f[k]] <= b[k], lo[k], hi[k])


class Boosted:
    """Multi-class boosting with histogram splits on the softmax loss."""

    def __init__(self, classes: int, rounds: int = 30, depth: int = 3, rate: float = 0.25, bins: int = 32, min_rows: int = 8) -> None:
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.min_rows = classes, rounds, depth, rate, bins, min_rows
        self.prior = np.zeros(classes)
        self.trees: list[list[Tree]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, d = x.shape
        onehot = np.eye(self.classes)[y]
        self.prior = np.log((onehot.sum(0) + 1) / (n + self.classes))
        if n < 2 * self.min_rows:
            return self  # too few rows for a split: the class shares are all there is
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(d)]
        coded = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)], 1)
        score = np.tile(self.prior, (n, 1))
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            turn = []
            for c in range(self.classes):
                tree = self._grow(coded, edges, onehot[:, c] - p[:, c], p[:, c] * (1 - p[:, c]))
                score[:, c] += tree.predict(x)
                turn.append(tree)
            self.trees.append(turn)
        return self

    def _grow(self, coded: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
        tree = Tree()
        todo = [(tree.node(), np.arange(len(g)), 0)]
        while todo:
            node, rows, level = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            tree.value[node] = self.rate * gs / (hs + 1)
            best = (1e-6, -1, 0)
            if level < self.depth and len(rows) >= 2 * self.min_rows:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    code = coded[rows, j]
                    gl = np.cumsum(np.bincount(code, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code, h[rows], len(e) + 1))[:-1]
                    nl = np.cumsum(np.bincount(code, minlength=len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(nl < self.min_rows) | (len(rows) - nl < self.min_rows)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
            if best[1] >= 0:
                _, j, k = best
                goes = coded[rows, j] <= k
                tree.feature[node], tree.bound[node] = j, float(edges[j][k])
                tree.left[node], tree.right[node] = tree.node(), tree.node()
                todo += [(tree.left[node], rows[goes], level + 1), (tree.right[node], rows[~goes], level + 1)]
        return tree

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.tile(self.prior, (len(x), 1))
        for turn in self.trees:
            for c, tree in enumerate(turn):
                score[:, c] += tree.predict(x)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def platt(p: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * logit(p) + b) is calibrated on the holdout; (1, 0) without labels of both kinds."""
    if len(y) == 0 or y.min() == y.max():
        return 1.0, 0.0
    z = np.log(np.clip(p, 1e-4, 1 - 1e-4) / np.clip(1 - p, 1e-4, 1))
    x = np.stack([z, np.ones_like(z)], 1)
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])

    def loss(v: np.ndarray) -> float:
        return float(np.sum(np.logaddexp(0, x @ v) - y * (x @ v)) + ((v - prior) ** 2).sum() / 2)

    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (y - q) - (w - prior))
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-4:
            size /= 2
        w = w + size * step
    return float(w[0]), float(w[1])
