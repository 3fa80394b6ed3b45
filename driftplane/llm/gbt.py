"""Gradient-boosted trees in numpy: histogram fit, monotonic limits, flat node arrays.

A fitted :class:`Forest` is a set of parallel arrays over all nodes of all trees
(feature, threshold, left, right, value), so that scoring is ``depth`` gathers a tree for
a whole batch of rows.  Fitting takes a bounded sample that fits the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                go = x[rows, self.feature[at]] <= self.threshold[at]
                at = np.where(go, self.left[at], self.right[at])
            out += self.value[at]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 2.0, min_leaf: float = 4.0, monotone: tuple[int, ...] | None = None) -> Forest:
    """Logistic loss.  ``monotone[j]``: +1 the score may only rise with feature j, -1 only
    fall, 0 free; kept by bounding the children's values at the middle of every
    constrained split.  An empty sample, or one class only, gives the constant model."""
    n, k = x.shape
    sign = monotone or (0,) * k
    p = (y.sum() + 0.5) / (n + 1)
    nodes: list[list] = []
    roots, base = [], float(np.log(p / (1 - p)))
    f = np.full(n, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, k), int)

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return min(hi, max(lo, -g / (h + l2)))

    def grow(rows: np.ndarray, left_depth: int, lo: float, hi: float, g: np.ndarray, h: np.ndarray) -> int:
        at, total_g, total_h = len(nodes), g[rows].sum(), h[rows].sum()
        nodes.append([0, np.inf, at, at, rate * leaf(total_g, total_h, lo, hi)])
        if left_depth == 0 or len(rows) < 2:
            f[rows] += nodes[at][4]
            return at
        best = (1e-6, None)
        for j in range(k):
            m = len(cuts[j]) + 1
            if m == 1:
                continue
            cg = np.cumsum(np.bincount(code[rows, j], g[rows], m))[:-1]
            ch = np.cumsum(np.bincount(code[rows, j], h[rows], m))[:-1]
            cn = np.cumsum(np.bincount(code[rows, j], minlength=m))[:-1]
            gain = cg**2 / (ch + l2) + (total_g - cg) ** 2 / (total_h - ch + l2) - total_g**2 / (total_h + l2)
            bad = (cn < min_leaf) | (len(rows) - cn < min_leaf)
            if sign[j]:
                rise = np.clip(-(total_g - cg) / (total_h - ch + l2), lo, hi) - np.clip(-cg / (ch + l2), lo, hi)
                bad |= rise * sign[j] < 0
            gain[bad] = 0
            if gain.max() > best[0]:
                c = int(gain.argmax())
                best = (gain[c], (j, c, leaf(cg[c], ch[c], lo, hi), leaf(total_g - cg[c], total_h - ch[c], lo, hi)))
        if best[1] is None:
            f[rows] += nodes[at][4]
            return at
        j, c, vl, vr = best[1]
        go, mid = code[rows, j] <= c, (vl + vr) / 2
        bounds = {0: ((lo, hi), (lo, hi)), 1: ((lo, mid), (mid, hi)), -1: ((mid, hi), (lo, mid))}[sign[j]]
        nodes[at][0], nodes[at][1] = j, cuts[j][c]
        nodes[at][2] = grow(rows[go], left_depth - 1, *bounds[0], g, h)
        nodes[at][3] = grow(rows[~go], left_depth - 1, *bounds[1], g, h)
        return at

    if n and 0 < y.sum() < n:
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            roots.append(grow(np.arange(n), depth, -np.inf, np.inf, q - y, np.maximum(q * (1 - q), 1e-9)))
    a = list(zip(*nodes, strict=True)) if nodes else [[], [], [], [], []]
    return Forest(np.array(a[0], np.int64), np.array(a[1], float), np.array(a[2], np.int64), np.array(a[3], np.int64), np.array(a[4], float), np.array(roots, np.int64), depth, base)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) for :func:`numpy.interp`."""
    if not len(score):
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, t in zip(score[order], y[order], strict=True):
        pools.append([t, 1.0, s, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            t1, n1, _, hi = pools.pop()
            pools[-1][0] += t1
            pools[-1][1] += n1
            pools[-1][3] = hi
    xs = [v for q in pools for v in (q[2], q[3])]
    ys = [v for q in pools for v in ((q[0] + 0.25) / (q[1] + 0.5),) * 2]
    return np.array(xs), np.maximum.accumulate(np.array(ys))
