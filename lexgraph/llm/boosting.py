"""Gradient-boosted trees for two classes, grown on histograms, flat in numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes side by side. feature < 0 marks a leaf; node ids are absolute."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all trees step down together, level by level."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[node], self.left[node], self.right[node])
                node = np.where(f < 0, node, down)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 10, penalty: float = 1.0) -> Forest:
    """Fit on rows ``x`` with labels ``y`` in {0, 1}.

    ``monotone`` has +1 or -1 for features the score may only rise or fall with,
    else 0. A split that breaks a constraint is refused, and both children are
    bounded by the mean of their values, so the constraint holds for whole trees.
    One class only, or no rows, gives a forest without trees.
    """
    if not len(y) or y.min() == y.max():
        rate_of_one = float(y.mean()) if len(y) else 1.0
        empty = np.zeros(0, np.int64)
        return Forest(empty, empty.astype(float), empty, empty, empty.astype(float), empty, float(np.log((rate_of_one + 1e-6) / (1 - rate_of_one + 1e-6))), depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    mean = y.mean()
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(at: int, rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, level: int) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value[at] = rate * float(np.clip(-total_g / (total_h + penalty), low, high))
        raw_gain, best = 1e-6, None
        if level == depth or len(rows) < 2 * least:
            raw[rows] += value[at]
            return
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            sums = [np.cumsum(np.bincount(binned[rows, j], w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None)]
            lg, lh, n = sums
            lv, rv = (np.clip(-a / (b + penalty), low, high) for a, b in ((lg, lh), (total_g - lg, total_h - lh)))
            gain = -(lg * lv + 0.5 * (lh + penalty) * lv**2) - ((total_g - lg) * rv + 0.5 * (total_h - lh + penalty) * rv**2)
            fits = (n >= least) & (len(rows) - n >= least) & (monotone[j] * (rv - lv) >= 0)
            gain = np.where(fits, gain, -np.inf)
            k = int(np.argmax(gain))
            v = np.clip(-total_g / (total_h + penalty), low, high)
            over = gain[k] + total_g * v + 0.5 * (total_h + penalty) * v**2
            if over > raw_gain:
                raw_gain, best = over, (j, k, float(lv[k]), float(rv[k]))
        if best is None:
            raw[rows] += value[at]
            return
        j, k, lv, rv = best
        goes = binned[rows, j] <= k
        feature[at], threshold[at] = j, float(cuts[j][k])
        left[at], right[at] = node(), node()
        mid = (lv + rv) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}.get(int(monotone[j]), ((low, high), (low, high)))
        grow(left[at], rows[goes], g, h, *bounds[0], level + 1)
        grow(right[at], rows[~goes], g, h, *bounds[1], level + 1)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        roots.append(node())
        grow(roots[-1], np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0)
    return Forest(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), base, depth)
