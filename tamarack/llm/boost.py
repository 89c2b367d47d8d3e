"""Gradient boosted trees for two classes, in numpy; small enough to train on the driver."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of trees of a fixed depth over binned features, with a calibrated output."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.slope, self.shift = 0.0, 1.0, 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        self.edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) > self.bins:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:]))
            self.edges.append((values[1:] + values[:-1]) / 2)
        binned = self._binned(x)
        width = max((len(e) for e in self.edges), default=0) + 1
        share = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        columns = np.arange(x.shape[1])
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            gradient, hessian = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, 32767, np.int64)
            at = np.ones(len(y), np.int64)
            for level in range(self.depth):
                for node in range(2**level, 2 ** (level + 1)):
                    rows = np.flatnonzero(at == node)
                    if len(rows) < 8:
                        continue
                    code = (binned[rows].astype(np.int64) + columns * width).ravel()
                    g = np.bincount(code, np.repeat(gradient[rows], len(columns)), width * len(columns)).reshape(-1, width).cumsum(1)
                    h = np.bincount(code, np.repeat(hessian[rows], len(columns)), width * len(columns)).reshape(-1, width).cumsum(1)
                    gt, ht = g[:, -1:], h[:, -1:]
                    gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                    gain[(h < self.least / 10) | (ht - h < self.least / 10)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[node], cut[node] = divmod(best, width)
                right = binned[np.arange(len(y)), feature[at]] > cut[at]
                at = 2 * at + right
            leaf = at - 2**self.depth
            g = np.bincount(leaf, gradient, 2**self.depth)
            h = np.bincount(leaf, hessian, 2**self.depth)
            value = self.rate * g / (h + 1)
            score += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(np.asarray(x, np.float64))
        score = np.full(len(binned), self.start)
        rows = np.arange(len(binned))
        for feature, cut, value in self.nodes:
            at = np.ones(len(binned), np.int64)
            for _ in range(self.depth):
                at = 2 * at + (binned[rows, feature[at]] > cut[at])
            score += value[at - 2**self.depth]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Platt scaling on rows that weren't used for the trees."""
        s, y = np.clip(self.raw(x), -12, 12), np.asarray(y, np.float64)
        a, b = 1.0, 0.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(a * s + b)))
            a += 0.5 * np.mean((y - p) * s) / (np.mean(p * (1 - p) * s * s) + 1e-3)
            b += 0.5 * np.mean(y - p) / (np.mean(p * (1 - p)) + 1e-3)
        self.slope, self.shift = float(max(a, 0.05)), float(b)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        return 1 / (1 + np.exp(-(self.slope * np.clip(self.raw(x), -12, 12) + self.shift)))


def threshold(p: np.ndarray, y: np.ndarray, recall: float = 0.995) -> float:
    """The cut with the best F1 on calibrated probabilities of held-out rows, at ``recall`` if that is possible."""
    y = np.asarray(y, bool)
    best, cut = -1.0, 0.5
    for t in np.linspace(0.05, 0.95, 37):
        found = p >= t
        hit = (found & y).sum()
        if not hit:
            continue
        precision, reached = hit / found.sum(), hit / y.sum()
        value = 2 * precision * reached / (precision + reached) - (reached < recall) * 0.01
        if value > best + 1e-9:
            best, cut = value, float(t)
    return cut
