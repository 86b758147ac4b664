"""Functional variance decomposition of a regression forest.

A tree cuts the parameter box into leaves; each leaf is a box with a value. With
parameters uniform on their ranges, the mean over all others is a step function
of one parameter (or of two), summed over the leaves exactly. Its variance over
the tree's variance is the share that the parameter (or the pair beyond its
members) explains; shares are averaged over the trees. The forest is fitted by
Spark; what is decomposed here has the model's size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from riskframe.operators.flat_trees import Forest


def _boxes(forest: Forest, root: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower ends, upper ends, values) of a tree's leaves inside the box."""
    out = []

    def walk(node: int, lo: np.ndarray, hi: np.ndarray) -> None:
        f = forest.feature[node]
        if f < 0:
            out.append((lo, hi, forest.values[node, 0]))
            return
        t = forest.threshold[node]
        if t > lo[f]:
            walk(forest.left[node], lo, np.where(np.arange(len(hi)) == f, np.minimum(hi, t), hi))
        if t < hi[f]:
            walk(forest.right[node], np.where(np.arange(len(lo)) == f, np.maximum(lo, t), lo), hi)

    walk(root, low, high)
    return np.array([o[0] for o in out]), np.array([o[1] for o in out]), np.array([o[2] for o in out])


def _marginal(lo: np.ndarray, hi: np.ndarray, value: np.ndarray, share: np.ndarray, which: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(widths of the steps of each parameter of ``which``, mean over all other parameters on every cell)."""
    others = [k for k in range(lo.shape[1]) if k not in which]
    weight = value * share[:, others].prod(axis=1)
    edges = [np.unique(np.concatenate([lo[:, k], hi[:, k]])) for k in which]
    inside = []
    for k, e in zip(which, edges, strict=True):
        mid = (e[:-1] + e[1:]) / 2
        inside.append(((mid > lo[:, k:k + 1]) & (mid < hi[:, k:k + 1])).astype(float))
    cells = inside[0].T @ weight if len(which) == 1 else np.einsum("la,lb,l->ab", *inside, weight)
    return [np.diff(e) for e in edges], cells


def variance_shares(forest: Forest, low, high) -> tuple[np.ndarray, dict[tuple[int, int], float]]:
    """Shares of every parameter and of every pair, averaged over the trees that vary at all."""
    low, high = np.asarray(low, dtype=float), np.asarray(high, dtype=float)
    width = np.where(high > low, high - low, 1.0)
    d = len(low)
    single, pair, trees = np.zeros(d), dict.fromkeys(combinations(range(d), 2), 0.0), 0
    for root in forest.roots:
        lo, hi, value = _boxes(forest, int(root), low, high)
        share = np.where(high > low, (hi - lo) / width, 1.0)
        volume = share.prod(axis=1)
        mean = float(volume @ value)
        total = float(volume @ (value - mean) ** 2)
        if total <= 1e-300:
            continue
        trees += 1
        alone = np.zeros(d)
        for k in range(d):
            if high[k] > low[k]:
                (w,), f = _marginal(lo, hi, value, share, (k,))
                alone[k] = float((w / width[k]) @ (f - mean) ** 2)
        single += alone / total
        for a, b in pair:
            if high[a] > low[a] and high[b] > low[b]:
                (wa, wb), f = _marginal(lo, hi, value, share, (a, b))
                both = float((wa / width[a]) @ (f - mean) ** 2 @ (wb / width[b]))
                pair[a, b] += max(both - alone[a] - alone[b], 0.0) / total
    return single / max(trees, 1), {k: v / max(trees, 1) for k, v in pair.items()}
