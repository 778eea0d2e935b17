"""Histogram gradient-boosted trees for a yes/no label, with flat arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays: inner nodes name a feature, a threshold and their left child (the right one follows)."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray  # a leaf names itself
    value: np.ndarray
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: all rows walk all trees together, one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[node]] > self.threshold[node]
            node = self.left[node] + right
        return self.base + self.value[node].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(x))) if len(x) else np.zeros(0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, min_rows: int = 10, l2: float = 1.0) -> Forest:
    """Boosting on the logistic loss. A table without rows or with one label gives a constant score."""
    if not len(y) or y.min() == y.max():
        base = 8.0 if not len(y) or y[0] else -8.0
        leaf = np.zeros(1, dtype=np.int64)
        return Forest(base, leaf, leaf, np.full(1, np.inf), leaf, np.zeros(1), 0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)
    roots, feature, threshold, left, value = [], [], [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(feature))
        open_nodes = [(_add(feature, threshold, left, value), np.arange(len(y)), 0)]
        while open_nodes:
            at, rows, level = open_nodes.pop()
            split = _best_split(binned[rows], grad[rows], hess[rows], edges, bins, min_rows, l2) if level < depth else None
            if split is None:
                value[at] = -rate * grad[rows].sum() / (hess[rows].sum() + l2)
                margin[rows] += value[at]
                continue
            j, b = split
            goes = binned[rows, j] > b
            feature[at], threshold[at] = j, float(edges[j][b])
            left[at] = _add(feature, threshold, left, value)
            right = _add(feature, threshold, left, value)
            open_nodes += [(left[at], rows[~goes], level + 1), (right, rows[goes], level + 1)]
    return Forest(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value), depth)


def _add(feature: list, threshold: list, left: list, value: list) -> int:
    """A new node, a leaf at first: every row stays on it."""
    at = len(feature)
    feature.append(0)
    threshold.append(np.inf)
    left.append(at)
    value.append(0.0)
    return at


def _best_split(binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray], bins: int, min_rows: int, l2: float) -> tuple[int, int] | None:
    """Feature and last bin of the left side with the largest gain, from one histogram over all features."""
    if len(grad) < 2 * min_rows:
        return None
    width, n = bins + 1, binned.shape[1]
    keys = (binned + np.arange(n) * width).ravel()
    g, h, c = (np.bincount(keys, weights=np.repeat(w, n) if w is not None else None, minlength=n * width).reshape(n, width).cumsum(axis=1) for w in (grad, hess, None))
    gain = g**2 / (h + l2) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
    allowed = (c >= min_rows) & (c[:, -1:] - c >= min_rows) & (np.arange(width) < np.array([len(e) for e in edges])[:, None])
    gain = np.where(allowed, gain, -np.inf)
    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(j), int(b)) if gain[j, b] > 1e-6 else None
