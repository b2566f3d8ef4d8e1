"""Gradient-boosted trees in numpy: histogram training with monotone constraints, flat arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in one set of arrays; a leaf has feature -1 and points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of the rows of ``x``; every row goes down every tree at once, level by level."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(f < 0, at, np.where(go_left, self.left[at], self.right[at]))
        return self.base + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic loss, second order. ``monotone``: +1 or -1 where the score may only rise or fall with a feature, else 0.

    A split of a constrained feature that orders its children wrongly is refused; below an accepted one,
    both sides are bounded by the children's midpoint, so the constraint holds for the whole tree.
    """
    n, m = x.shape
    p = (y.sum() + 1) / (n + 2) if n else 0.5
    base = float(np.log(p / (1 - p)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if n:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
        width = bins + 1
        flat = binned + np.arange(m) * width
        score = np.full(n, base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + l2), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        node = len(feature)
        for a, v in ((feature, -1), (threshold, 0.0), (left, node), (right, node), (value, 0.0)):
            a.append(v)
        gs, hs = g[rows].sum(), h[rows].sum()
        value[node] = rate * leaf(gs, hs, low, high)
        if level == depth or hs < 2 * least:
            return node
        idx = flat[rows].ravel()
        gl = np.bincount(idx, np.repeat(g[rows], m), m * width).reshape(m, width).cumsum(1)
        hl = np.bincount(idx, np.repeat(h[rows], m), m * width).reshape(m, width).cumsum(1)
        wl = np.clip(-gl / (hl + l2), low, high)
        wr = np.clip(-(gs - gl) / (hs - hl + l2), low, high)
        loss = lambda w, a, b: -(a * w + 0.5 * (b + l2) * w * w)
        gain = loss(wl, gl, hl) + loss(wr, gs - gl, hs - hl) - loss(leaf(gs, hs, low, high), gs, hs)
        bad = (hl < least) | (hs - hl < least) | ((wr - wl) * monotone[:, None] < 0)
        gain = np.where(bad, -np.inf, gain)
        j, b = divmod(int(gain.argmax()), width)
        if not gain[j, b] > 1e-6 or b >= len(cuts[j]):
            return node
        mid = (wl[j, b] + wr[j, b]) / 2
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}[int(monotone[j])]
        go = binned[rows, j] <= b
        feature[node], threshold[node], value[node] = j, float(cuts[j][b]), 0.0
        left[node] = grow(rows[go], g, h, level + 1, *bounds[0])
        right[node] = grow(rows[~go], g, h, level + 1, *bounds[1])
        return node

    for _ in range(trees if n else 0):
        q = 1 / (1 + np.exp(-score))
        first = len(feature)
        roots.append(grow(np.arange(n), q - y, np.maximum(q * (1 - q), 1e-6), 0, -np.inf, np.inf))
        tree = Forest(np.array([first]), *(np.array(a) for a in (feature, threshold, left, right, value)), base=0.0, depth=depth)
        score = score + tree.raw(x)
    return Forest(np.array(roots, np.int64), np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), base, depth)
