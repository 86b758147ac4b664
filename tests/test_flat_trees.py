"""Flat trees against Spark's own transform, brute force and subset enumeration."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate as ev, explain, flat_trees as ft, models

COLS = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(700, 6)), 1)
    x[:, 5] = 3.0  # constant
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["label"] = ((x[:, 0] * x[:, 1] > 0) ^ (x[:, 2] > 0.8) ^ (rng.random(700) < 0.1)).astype(int)
    pdf["loan_id"] = np.arange(700)
    return spark.createDataFrame(pdf).repartition(3).persist(), pdf


ESTIMATORS = {"gbt": lambda: models.gbt(6, 3), "forest": lambda: models.random_forest(7, 4), "tree": lambda: models.decision_tree(8),
              "deep": lambda: models.random_forest(3, 12, min_rows=1)}


@pytest.mark.parametrize("scaler", [None, "minmax", "standard"])
@pytest.mark.parametrize("kind", list(ESTIMATORS))
def test_scores_equal_transform(planted, kind, scaler):
    df, pdf = planted
    model = models.fit(df, COLS, ESTIMATORS[kind](), scaler=scaler)
    want = models.score(model, df, COLS).toPandas().sort_values("loan_id")
    p, hard = ft.flatten(model).score(pdf[COLS].to_numpy())
    assert np.allclose(p, want["score"], rtol=0, atol=1e-12) and (hard == want["prediction"]).all()


@pytest.mark.parametrize("metric", ["accuracy", "auc"])
def test_importance_equals_scored_copies(planted, metric):
    df, _ = planted
    model = models.fit(df, COLS, models.gbt(6, 3), scaler="minmax")
    got = {r["feature"]: (r["weight"], r["std"]) for r in explain.permutation_importance(model, df, "loan_id", COLS, 2, metric).collect()}

    def value(t):
        if metric == "auc":
            return ev.auc(t.withColumn("g", F.lit(1)), ["g"]).first()["auc"]
        return t.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]

    base = value(models.score(model, df, COLS))
    copies = models.score(model, explain.permuted_copies(df, "loan_id", COLS, 2), COLS, keep=("loan_id", "label", "perm_feature", "repeat")).persist()
    for f in COLS:
        drops = [base - value(copies.filter((F.col("perm_feature") == f) & (F.col("repeat") == r))) for r in range(2)]
        assert got[f] == pytest.approx((np.mean(drops), np.std(drops)), abs=1e-9)
    copies.unpersist()


def test_rows_with_nulls_are_left_out(spark, planted):
    df, _ = planted
    model = models.fit(df, COLS, models.gbt(3, 2), scaler=None)
    holes = df.withColumn("x1", F.when(F.col("loan_id") % 5 != 0, F.col("x1"))).withColumn(
        "x2", F.when(F.col("loan_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("x2")))
    kept = {r["loan_id"] for r in models.score(model, holes, COLS).collect()}
    assert {r["loan_id"] for r in explain.tree_shapley(model, holes, "loan_id", COLS)[0].select("loan_id").distinct().collect()} == kept
    assert {r["loan_id"] for r in explain.lime(model, df, holes, "loan_id", COLS, n_samples=20).select("loan_id").distinct().collect()} == kept
    for part in (df.limit(0),):
        assert explain.lime(model, df, part, "loan_id", COLS).collect() == [] and explain.tree_shapley(model, part, "loan_id", COLS)[0].collect() == []


def test_lime_solves_the_weighted_ridge_of_its_draws(spark, planted):
    df, pdf = planted
    model = models.fit(df, COLS[:5], models.gbt(6, 3), scaler=None)
    row = pdf.iloc[[11]]
    got = explain.lime(model, df, spark.createDataFrame(row), "loan_id", COLS[:5], n_samples=300, top=5).toPandas().set_index("feature")["weight"]
    seed = spark.range(11, 12).select(F.xxhash64("id")).first()[0]
    z = np.random.Generator(np.random.SFC64([seed & (2 ** 64 - 1), 0])).standard_normal((300, 5))
    z[0] = 0
    sd = pdf[COLS[:5]].std().to_numpy()
    x = pd.DataFrame(row[COLS[:5]].to_numpy() + z * sd, columns=COLS[:5]).assign(label=0, loan_id=range(300))
    y = models.score(model, spark.createDataFrame(x), COLS[:5]).toPandas().sort_values("loan_id")["score"].to_numpy()
    w = np.sqrt(np.exp(-(z ** 2).sum(axis=1) / (0.75 ** 2 * 5)))
    a, t = np.hstack([z, np.ones((300, 1))]) * w[:, None], y * w
    ridge = np.vstack([a, np.diag([1.0] * 5 + [0.0])])
    want = np.linalg.lstsq(ridge, np.append(t, np.zeros(6)), rcond=None)[0][:5]
    assert np.allclose([got[c] for c in COLS[:5]], want, atol=1e-8)


def worth(forest, x, present, output):
    """Output of the row with absent features averaged by the training rows of each branch."""
    def walk(node):
        f = forest.feature[node]
        if f < 0:
            return forest.values[node, output]
        left, right = forest.left[node], forest.right[node]
        if f in present:
            return walk(left if x[f] <= forest.threshold[node] else right)
        return (forest.cover[left] * walk(left) + forest.cover[right] * walk(right)) / forest.cover[node]
    return sum(w * walk(r) for w, r in zip(forest.weights, forest.roots, strict=True))


@pytest.mark.parametrize(("kind", "output"), [("gbt", 0), ("forest", 1), ("deep", 1)])
def test_shapley_equals_subset_enumeration(spark, planted, kind, output):
    df, pdf = planted
    model = models.fit(df, COLS, ESTIMATORS[kind](), scaler="minmax")
    forest = ft.flatten(model)
    some = spark.createDataFrame(pdf.iloc[::50])
    phi, mean, expected = explain.tree_shapley(model, some, "loan_id", COLS, output)
    got = phi.toPandas().pivot(index="loan_id", columns="feature", values="phi")[COLS]
    for i, row in pdf.iloc[::50].iterrows():
        x = forest.columns(row[COLS].to_numpy(dtype=float)[None, :])[:, 0]
        v = {s: worth(forest, x, set(s), output) for k in range(7) for s in combinations(range(6), k)}
        for j in range(6):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / math.factorial(6) * (v[tuple(sorted((*s, j)))] - v[s])
                       for s in v if j not in s)
            assert got.loc[row["loan_id"], COLS[j]] == pytest.approx(want, abs=1e-10)
        assert expected == pytest.approx(v[()], abs=1e-10)
        assert expected + got.loc[row["loan_id"]].sum() == pytest.approx(v[tuple(range(6))], abs=1e-10)
    assert mean.filter("feature = 'x0'").first()["mean_abs_phi"] == pytest.approx(got["x0"].abs().mean())


@pytest.mark.parametrize(("count", "n"), [(19, 7920), (5, 5), (7, 3), (3, 1)])
def test_shadow_shifts_differ(count, n):
    for r in range(20):
        shifts = explain.shadow_shifts(count, n, r)
        assert len(shifts) == count and len(set(shifts)) == min(count, n) and max(shifts) < n


def test_lime_looks_small_trees_up_in_tables():
    rng = np.random.default_rng(5)
    for depth, outputs in ((3, 1), (3, 2), (5, 1)):  # depth 5 has more cuts than a table takes
        inner, size = 2 ** depth - 1, 2 ** (depth + 1) - 1
        feature = np.tile([int(rng.integers(3)) if i < inner and i != 1 else -1 for i in range(size)], 4)
        at = np.arange(4 * size)
        head = at // size * size
        forest = ft.Forest(feature, rng.normal(size=4 * size).round(1), 2 * at - head + 1, 2 * at - head + 2,
                                   rng.random((4 * size, outputs)), np.ones(4 * size), np.arange(4) * size, np.array([1.0, 0.5, 0.4, 0.3]),
                                   slope=2.0 if outputs == 1 else 0.0, shift=np.full(3, 0.1), factor=np.full(3, 0.9), add=np.zeros(3))
        tabled = ft._tabled(forest)
        assert (tabled is None) == (depth == 5)
        x, sds = rng.normal(size=3), np.array([0.5, 1.0, 2.0])
        z = rng.normal(size=(500, 3))
        if tabled is not None:
            assert np.array_equal(ft.scores_around(forest, tabled, x, z, sds), forest.score(x + z * sds)[0])


@pytest.mark.parametrize(("depth", "coded"), [(3, 12), (5, 12), (5, 2)])
def test_shapley_patterns_are_looked_up_without_sorting_rows(monkeypatch, depth, coded):
    rng = np.random.default_rng(6)
    inner, size = 2 ** depth - 1, 2 ** (depth + 1) - 1
    feature = np.tile([int(rng.integers(6)) if i < inner else -1 for i in range(size)], 3)
    at = np.arange(3 * size)
    head = at // size * size
    cover = np.zeros(3 * size)
    for n in reversed(range(3 * size)):
        i, root = n % size, n // size * size
        cover[n] = rng.integers(5, 50) if i >= inner else cover[root + 2 * i + 1] + cover[root + 2 * i + 2]
    forest = ft.Forest(feature, rng.normal(size=3 * size).round(1), 2 * at - head + 1, 2 * at - head + 2, rng.random((3 * size, 1)), cover,
                       np.arange(3) * size, np.ones(3))
    x = rng.normal(size=(300, 6))
    parts = ft.leaves(forest, 0)
    want = np.zeros(x.shape)
    for leaf in parts:
        z = x[:, leaf.features]
        want[:, leaf.features] += leaf.value * ft.path_credits(((z > leaf.low) & (z <= leaf.high)).astype(float), leaf.share)
    monkeypatch.setattr(ft, "CODED_PATH", coded)
    if coded == 12:
        monkeypatch.setattr(ft.np, "unique", None)  # sorting the rows of every leaf was most of the work
    assert np.allclose(ft.shapley_values(forest, x, parts), want, atol=1e-12)
