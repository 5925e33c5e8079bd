"""Gradient-boosted trees for two classes, on binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete trees of one depth: feature and cut of each inner node, value of each leaf."""

    features: np.ndarray  # trees x (2^depth - 1)
    cuts: np.ndarray
    leaves: np.ndarray  # trees x 2^depth
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, ridge: float = 2.0) -> BoostedTrees:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], 1)
        share = (y * weight).sum() / weight.sum()
        bias = float(np.log(share / (1 - share)))
        score = np.full(n, bias)
        all_f, all_c, all_l = [], [], []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
            node = np.zeros(n, np.int64)
            tree_f, tree_c = [], []
            for level in range(depth):
                m = 2**level
                flat = ((node[:, None] * f + np.arange(f)) * bins + binned).ravel()
                gs = np.bincount(flat, np.repeat(g, f), m * f * bins).reshape(m, f, bins).cumsum(2)
                hs = np.bincount(flat, np.repeat(h, f), m * f * bins).reshape(m, f, bins).cumsum(2)
                gt, ht = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                best = gain.reshape(m, -1).argmax(1)
                bf, bb = best // bins, best % bins
                tree_f += bf.tolist()
                tree_c += [edges[k][b] if b < len(edges[k]) else np.inf for k, b in zip(bf, bb, strict=True)]
                node = node * 2 + (binned[np.arange(n), bf[node]] > bb[node])
            leaf = np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge) * rate
            score += leaf[node]
            all_f.append(tree_f)
            all_c.append(tree_c)
            all_l.append(leaf)
        return cls(np.array(all_f), np.array(all_c, float), np.array(all_l), bias)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, c, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - inner]
        return out
