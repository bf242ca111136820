"""Gradient-boosted trees for two classes, in numpy: small models that are trained on the driver and run in Arrow batches."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, histogram splits, depth-limited trees. Trees are flat arrays: feature, threshold, leaf values."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: int = 8, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.l2 = trees, depth, rate, bins, least, l2
        self.base = 0.0
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        p = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        if not len(y):
            return self
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
            feat, cut, leaf = np.full(2**self.depth - 1, -1), np.zeros(2**self.depth - 1), np.zeros(2**self.depth)
            at = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    best = self._split(codes[rows], g[rows], h[rows], cuts) if len(rows) >= 2 * self.least else None
                    if best is not None:
                        feat[node], k = best
                        cut[node] = cuts[feat[node]][k]
                        right = codes[rows, feat[node]] > k
                    else:
                        right = np.zeros(len(rows), bool)
                    at[rows] = 2 * node + 1 + right
            slot = at - (2**self.depth - 1)
            gs, hs = np.bincount(slot, g, 2**self.depth), np.bincount(slot, h, 2**self.depth)
            leaf = -self.rate * gs / (hs + self.l2)
            score += leaf[slot]
            self.nodes.append((feat, cut, leaf))
        return self

    def _split(self, codes: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
        top, pick = 1e-6, None
        gt, ht = g.sum(), h.sum()
        whole = gt * gt / (ht + self.l2)
        for f, c in enumerate(cuts):
            if not len(c):
                continue
            n = len(c) + 1
            gl, hl = np.cumsum(np.bincount(codes[:, f], g, n))[:-1], np.cumsum(np.bincount(codes[:, f], h, n))[:-1]
            nl = np.cumsum(np.bincount(codes[:, f], minlength=n))[:-1]
            gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - whole
            gain[(nl < self.least) | (len(g) - nl < self.least)] = -1
            k = int(gain.argmax())
            if gain[k] > top:
                top, pick = gain[k], (f, k)
        return pick

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        score = np.full(len(x), self.base)
        for feat, cut, leaf in self.nodes:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feat[at]
                right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at])
                at = 2 * at + 1 + right
            score += leaf[at - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))
