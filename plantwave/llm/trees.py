"""Gradient-boosted regression trees for two classes, in numpy.

Features are binned at quantiles; a tree is grown depth by depth over histograms of gradients.  Made for
training samples of some ten thousand rows on the driver and for scoring whole batches in tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Complete binary tree: node i has the children 2i+1 (value <= cut) and 2i+2."""
    feature: np.ndarray   # -1 where the node is a leaf
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        depth = int(np.log2(len(self.feature) + 1)) - 1
        rows = np.arange(len(x))
        for _ in range(depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + right, at)
        return self.value[at]


@dataclass
class Boosted:
    base: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 32,
        least: float = 1.0, shrink: float = 1.0, weight: np.ndarray | None = None) -> Boosted:
    """Boost `rounds` trees on the logistic loss; `least` is the smallest hessian sum of a child."""
    n, width = x.shape
    weight = np.ones(n) if weight is None else weight
    share = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], bins) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    most = bins + 2
    flat = binned + np.arange(width) * most
    score, trees = np.full(n, base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * np.maximum(p * (1 - p), 1e-6)
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth + 1):
            for node in range(2 ** level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                tree.value[node] = rate * g[rows].sum() / (h[rows].sum() + shrink)
                if level == depth:
                    continue
                places = flat[rows].ravel()
                gs = np.bincount(places, np.repeat(g[rows], width), width * most).reshape(width, most).cumsum(axis=1)
                hs = np.bincount(places, np.repeat(h[rows], width), width * most).reshape(width, most).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + shrink) + (gt - gs) ** 2 / (ht - hs + shrink) - gt**2 / (ht + shrink)
                gain[(hs < least) | (ht - hs < least)] = 0
                j, k = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, k] <= 1e-6 or k >= len(cuts[j]):
                    continue
                tree.feature[node], tree.cut[node] = j, cuts[j][k]
                at[rows] = 2 * node + 1 + (binned[rows, j] > k)
        score = score + tree.predict(x)
        trees.append(tree)
    return Boosted(base, trees)


def paths(model: Boosted) -> list[tuple[tuple[int, bool, float], ...]]:
    """All root-to-node paths as conjunctions of (feature, above, cut), without repeats."""
    found = {}
    for tree in model.trees:
        stack = [(0, ())]
        while stack:
            node, path = stack.pop()
            if path:
                found.setdefault(_tight(path))
            if tree.feature[node] >= 0:
                f, c = int(tree.feature[node]), float(tree.cut[node])
                stack += [(2 * node + 1, (*path, (f, False, c))), (2 * node + 2, (*path, (f, True, c)))]
    return list(found)


def _tight(path):
    """The same conjunction with one bound per feature and side."""
    best: dict[tuple[int, bool], float] = {}
    for f, above, c in path:
        old = best.get((f, above))
        best[f, above] = c if old is None else max(old, c) if above else min(old, c)
    return tuple(sorted((f, above, c) for (f, above), c in best.items()))
