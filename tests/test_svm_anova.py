"""Squared-hinge support vectors by their optimality conditions; variance shares by numeric integration."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor

from riskframe.operators import anova, flat_trees, models, svm

COLS = [f"x{i}" for i in range(5)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(400, 5)) * [1, 5, 0.2, 1, 1]
    x[:, 4] = 2.0  # constant
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["label"] = (x[:, 0] - 0.2 * x[:, 1] + 0.7 * rng.normal(size=400) > 0).astype(int)
    pdf["value"] = np.sin(2 * x[:, 0]) + x[:, 0] * x[:, 1] / 5 + 0.1 * rng.normal(size=400)
    return spark.createDataFrame(pdf).repartition(3).persist(), pdf


@pytest.mark.parametrize(("penalty", "c"), [("l2", 1.0), ("l2", 0.01), ("l1", 1.0), ("l1", 0.05), ("l1", 1e-6)])
def test_optimality_conditions(planted, penalty, c):
    df, pdf = planted
    fit = svm.squared_hinge(df, COLS, C=c, penalty=penalty)
    x = pdf[COLS].to_numpy()
    width = x.max(axis=0) - x.min(axis=0)
    z = (x - x.min(axis=0)) / np.where(width > 0, width, 1)
    y = 2 * pdf["label"].to_numpy() - 1
    w, b = fit.model.coefficients, fit.model.intercept
    short = np.maximum(1 - y * (z @ w + b), 0)
    g = -2 * c * z.T @ (y * short)
    scale = np.abs(2 * c * np.hstack([z, np.ones((400, 1))]).T @ y).max()
    assert abs(2 * c * (y * short).sum()) < 1e-6 * scale and fit.violation < 1e-6
    if penalty == "l2":
        assert np.abs(g + w).max() < 1e-6 * scale
    else:
        assert np.abs(np.where(w != 0, g + np.sign(w), np.maximum(np.abs(g) - 1, 0))).max() < 1e-6 * scale
        assert (w == 0).any()
    own = 0.5 * w @ w if penalty == "l2" else np.abs(w).sum()
    assert fit.objective[-1] == pytest.approx(own + c * (short ** 2).sum())
    assert all(b <= a + 1e-9 for a, b in zip(fit.objective, fit.objective[1:])) and fit.active == (short > 0).sum()
    p, hard = fit.model.score(x)
    assert (hard == (z @ w + b > 0)).all() and (c < 0.05 or (hard == pdf["label"]).mean() > 0.75)


def test_scored_like_any_model(planted):
    df, pdf = planted
    fit = svm.squared_hinge(df, COLS)
    got = models.score(fit.model, df, COLS, keep=("x0", "label")).toPandas()
    assert len(got) == 400 and sorted(got["score"]) == pytest.approx(sorted(fit.model.score(pdf[COLS].to_numpy())[0]))


def test_variance_shares_equal_numeric_integration(planted):
    df, pdf = planted
    cols = COLS[:3] + ["x4"]  # one parameter without a range
    model = models.fit(df.drop("label").withColumnRenamed("value", "label"), cols,
                       RandomForestRegressor(featuresCol="unscaledFeatures", labelCol="label", numTrees=3, maxDepth=4, seed=3), scaler=None)
    forest = flat_trees.flatten(model)
    want = models.PipelineModel(stages=model.stages).transform(df.drop("label")).select("prediction").toPandas()["prediction"]
    got = forest.raw(forest.columns(df.select(*cols).toPandas().to_numpy()))[0] / len(forest.roots)
    assert np.allclose(sorted(got), sorted(want))
    lo, hi = pdf[cols].min().to_numpy(), pdf[cols].max().to_numpy()
    single, pair = anova.variance_shares(forest, lo, hi)
    n = 60
    axes = [lo[k] + (np.arange(n) + 0.5) / n * (hi[k] - lo[k]) for k in range(3)]
    grid = np.stack([*np.meshgrid(*axes, indexing="ij"), np.full((n, n, n), 2.0)], axis=-1).reshape(-1, 4)
    alone, both = np.zeros(3), np.zeros((3, 3))
    for t in range(3):
        v = forest.tree(t, forest.columns(grid))[0].reshape(n, n, n)
        total = v.var()
        means = [v.mean(axis=tuple(k for k in range(3) if k != j)) for j in range(3)]
        alone += [m.var() / total / 3 for m in means]
        for a in range(3):
            for b in range(a + 1, 3):
                joint = v.mean(axis=next(k for k in range(3) if k not in (a, b)))
                both[a, b] += (joint.var() - means[a].var() - means[b].var()) / total / 3
    assert np.allclose(single[:3], alone, atol=0.03) and single[3] == 0
    for a in range(3):
        for b in range(a + 1, 3):
            assert pair[a, b] == pytest.approx(max(both[a, b], 0), abs=0.03)
    assert 0.9 < single.sum() + sum(pair.values()) < 1 + 1e-9


def test_variance_shares_of_a_known_function():
    # f = 1[x <= 1/4] + 2·1[y <= 1/2], two trees on the unit square
    a = flat_trees.Forest(np.array([0, -1, 1, -1, -1]), np.array([0.25, 0, 0.5, 0, 0]), np.array([1, 0, 3, 0, 0]), np.array([2, 0, 4, 0, 0]),
                          np.array([[0], [3.0], [0], [2.0], [0]]), np.ones(5), np.array([0]), np.ones(1))
    single, pair = anova.variance_shares(a, [0, 0], [1, 1])
    # means over y: 3 below 1/4, 1 above; over x: 9/4 below 1/2, 3/4 above
    total = 0.25 * 9 + 0.375 * 4 - 1.5 ** 2
    assert single == pytest.approx([(0.25 * 9 + 0.75 * 1 - 1.5 ** 2) / total, ((2.25 - 1.5) ** 2) / total])
    assert single.sum() + pair[0, 1] == pytest.approx(1.0) and math.isfinite(total)
