"""Linear support vectors with squared hinge loss, L2 or L1 penalty (M7).

Minimises penalty(w) + C Σ max(0, 1 - y(w·z + b))², with z the features on
[0, 1], y = ±1, penalty ½|w|² or |w|₁ and b free. A step is one pass over the
rows: only rows inside the margin (the active set) add to gradient and
generalised Hessian, which are sums of the features' size. The penalised
quadratic model is solved on the driver and the step is halved until the
objective falls enough.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame

from riskframe.operators.explain import _model_minimum, _ranges
from riskframe.operators.flat_trees import Linear
from riskframe.plans.gram import block_sums, row_blocks


class Fit(NamedTuple):
    model: Linear
    objective: list[float]
    violation: float  # of the optimality conditions, as a share of the gradient at zero
    active: int  # rows inside the margin


def _violation(g: np.ndarray, w: np.ndarray, penalty: str) -> float:
    """Largest part of the (least) subgradient of the objective."""
    out = g.copy()
    if penalty == "l2":
        out[:-1] += w[:-1]
    else:
        at_zero = w[:-1] == 0
        out[:-1] = np.where(at_zero, np.sign(g[:-1]) * np.maximum(np.abs(g[:-1]) - 1, 0), g[:-1] + np.sign(w[:-1]))
    return float(np.abs(out).max())


def squared_hinge(df: DataFrame, features, C: float = 1.0, penalty: str = "l2", max_iter: int = 100, tol: float = 1e-8) -> Fit:
    """Fit on complete rows; ends when the optimality conditions hold to ``tol`` of the gradient at zero."""
    if penalty not in ("l1", "l2"):
        raise ValueError("penalty is 'l1' or 'l2'")
    feats, d = list(features), len(list(features))
    data = row_blocks(df, [*feats, "label"]).persist()
    lo, width = _ranges(data, d + 1, d)

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        def sums(x: np.ndarray) -> np.ndarray:
            z = np.hstack([(x[:, :-1] - lo) / width, np.ones((len(x), 1))])
            y = 2 * x[:, -1] - 1
            short = 1 - y * (z @ w)
            live = short > 0
            za, sa = z[live], short[live]
            return np.concatenate([[live.sum(), (sa ** 2).sum()], -2 * za.T @ (y[live] * sa), (2 * za.T @ za).ravel()])
        v = block_sums(data, d + 1, sums)
        own = 0.5 * float(w[:-1] @ w[:-1]) if penalty == "l2" else float(np.abs(w[:-1]).sum())
        return own + C * v[1], C * v[2:d + 3], C * v[d + 3:].reshape(d + 1, d + 1), int(v[0])

    w = np.zeros(d + 1)
    value, g, h, active = look(w)
    scale, path = max(float(np.abs(g).max()), 1e-300), [value]
    for _ in range(max_iter):
        if _violation(g, w, penalty) <= tol * scale:
            break
        if penalty == "l2":
            ridge = np.diag([1.0] * d + [1e-12])
            target = w - np.linalg.solve(h + ridge, g + np.append(w[:-1], 0.0))
        else:
            target = _model_minimum(g, h + 1e-9 * np.eye(d + 1), w, [], 0.0, 1.0)
        step = 1.0
        while True:
            new = w + step * (target - w)
            new_value, new_g, new_h, new_active = look(new)
            if new_value <= value + 1e-12 * abs(value) or step < 1e-8:
                break
            step /= 2
        w, value, g, h, active = new, new_value, new_g, new_h, new_active
        path.append(value)
    data.unpersist()
    return Fit(Linear(w[:-1], float(w[-1]), lo, 1 / width, np.zeros(d)), path, _violation(g, w, penalty) / scale, active)
