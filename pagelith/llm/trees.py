"""Gradient-boosted trees for binary labels, flattened into numpy node arrays.

Trees grow on binned features with second-order gains. A feature may be declared
monotone (+1 or -1): a split that breaks the order of its children is refused, and
the children's values are bounded by the midpoint, so the bound holds below too.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees: a leaf has feature -1; roots has each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of every row; all rows walk down a tree together."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                leaf = f < 0
                if leaf.all():
                    break
                go_left = x[rows, np.where(leaf, 0, f)] <= self.threshold[node]
                node = np.where(leaf, node, np.where(go_left, self.left[node], self.right[node]))
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[:-1] + values[1:]) / 2


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 40,
    depth: int = 4,
    rate: float = 0.2,
    bins: int = 64,
    min_leaf: float = 5.0,
    ridge: float = 1.0,
    monotone: dict[int, int] | None = None,
    weight: np.ndarray | None = None,
) -> Forest:
    """Trains on rows x and labels y (0/1). With one class only, the forest is a constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    mean = float(np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    cuts = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if len(y) else x
    margin, monotone = np.full(len(y), base), monotone or {}

    def new(v: float) -> int:
        for a, b in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, v)):
            a.append(b)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> int:
        sg, sh = g[rows].sum(), h[rows].sum()
        node = new(float(np.clip(-sg / (sh + ridge), low, high)) * rate)
        if level == depth or len(rows) < 2 * min_leaf:
            step[rows] = value[node]
            return node
        best = (1e-6, -1, -1, 0.0, 0.0)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            b = binned[rows, j]
            gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
            nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(sg - gl) / (sh - hl + ridge), low, high)
            gain = gl**2 / (hl + ridge) + (sg - gl) ** 2 / (sh - hl + ridge) - sg**2 / (sh + ridge)
            ok = (nl >= min_leaf) & (len(rows) - nl >= min_leaf)
            if (sign := monotone.get(j, 0)) != 0:
                ok &= sign * (vr - vl) >= 0
            gain = np.where(ok, gain, -1)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k, vl[k], vr[k])
        _, j, k, vl, vr = best
        if j < 0:
            step[rows] = value[node]
            return node
        mid, sign = (vl + vr) / 2, monotone.get(j, 0)
        down = binned[rows, j] <= k
        bounds = ((low, mid), (mid, high)) if sign > 0 else ((mid, high), (low, mid)) if sign < 0 else ((low, high),) * 2
        feature[node], threshold[node] = j, float(cuts[j][k])
        left[node] = grow(rows[down], g, h, *bounds[0], level + 1)
        right[node] = grow(rows[~down], g, h, *bounds[1], level + 1)
        return node

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            step = np.zeros(len(y))
            roots.append(grow(np.arange(len(y)), w * (p - y), w * np.maximum(p * (1 - p), 1e-6), -8.0, 8.0, 0))
            margin = margin + step
    return Forest(
        np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64),
        np.array(value, float), np.array(roots, np.int64), base, depth + 1,
    )
