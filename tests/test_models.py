"""Fits, searches and explanations against numpy, their optimality conditions or known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import corr, evaluate as ev, explain, models, resample, search
from riskframe.sources import fixtures as fx

SF_SMALL = "/root/testdata/sf0.001"

COLS = ["int_rate", "n_items", "avg_disc", "annual_inc"]


@pytest.fixture(scope="module")
def loans(spark):
    return fx.loans_model(spark, SF_SMALL).select("loan_id", "label", *[F.col(c).cast("double").alias(c) for c in COLS]).persist()


@pytest.fixture(scope="module")
def table(loans):
    return loans.toPandas()


@pytest.fixture(scope="module")
def planted(spark):
    """x0 decides the label, x1 helps, the others are noise."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6))
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(6)])
    pdf["label"] = (2 * x[:, 0] + x[:, 1] + 0.3 * rng.normal(size=600) > 0).astype(int)
    pdf["loan_id"] = np.arange(600)
    return spark.createDataFrame(pdf).persist(), pdf


def newton(x, y, l2, scale):
    """Mean logistic loss + l2/2 · |scale·w|², intercept free."""
    z = np.hstack([x, np.ones((len(x), 1))])
    d = np.append(l2 * scale ** 2, 0.0)
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ w))
        g = z.T @ (p - y) / len(y) + d * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(d)
        w = w - np.linalg.solve(h, g)
    return w


@pytest.mark.parametrize("reg", [0.0, 0.01])
def test_logistic_matches_newton(loans, table, reg):
    model = models.fit(loans, COLS, models.logistic(reg, 0.0, 500, tol=1e-12), scaler=None).stages[-1]
    x = table[COLS].to_numpy(float)
    sd = x.std(axis=0, ddof=1)
    # Spark penalises coefficients of columns divided by their standard deviation
    w = newton((x - x.mean(axis=0)) / sd, table["label"].to_numpy(float), reg, np.ones(len(COLS)))
    assert np.allclose(model.coefficients.toArray() * sd, w[:-1], rtol=1e-3, atol=1e-4)


def test_lasso_zeroes_and_l2_does_not(loans):
    l1 = models.fit(loans, COLS, models.logistic(0.05, 1.0, 200), scaler="standard").stages[-1].coefficients.toArray()
    l2 = models.fit(loans, COLS, models.logistic(0.05, 0.0, 200), scaler="standard").stages[-1].coefficients.toArray()
    assert (l1 == 0).any() and (l2 != 0).all()


def test_group_lasso_meets_its_optimality_conditions(planted):
    df, pdf = planted
    cols = [f"x{i}" for i in range(6)]
    groups = {"a": ["x0", "x1"], "b": ["x2", "x3"], "c": ["x4", "x5"]}
    reg = 0.02
    gt, curve, acc, (beta, b0, (lo, width)), converged = explain.group_lasso(df, cols, groups, group_reg=reg, tol=1e-9)
    z = (pdf[cols].to_numpy() - lo) / width
    p = 1 / (1 + np.exp(-(z @ beta + b0)))
    grad = z.T @ (p - pdf["label"].to_numpy()) / len(pdf)
    assert converged and abs((p - pdf["label"]).mean()) < 1e-6
    for names in groups.values():
        i = [cols.index(c) for c in names]
        limit = reg * math.sqrt(len(i))
        if np.linalg.norm(beta[i]) > 0:  # the gradient balances the penalty
            assert np.allclose(grad[i], -limit * beta[i] / np.linalg.norm(beta[i]), atol=1e-6)
        else:  # inside the subgradient ball
            assert np.linalg.norm(grad[i]) <= limit + 1e-8
    losses = [r["loss"] for r in curve.orderBy("iteration").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:])) and acc > 0.9
    assert {r["group"] for r in gt.filter("selected").collect()} == {"a"}


def test_tree_of_depth_one_takes_the_best_split(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.integers(0, 12, 400).astype(float), "b": rng.integers(0, 12, 400).astype(float)})
    pdf["label"] = ((pdf["b"] > 6) ^ (rng.random(400) < 0.1)).astype(int)
    tree = models.fit(spark.createDataFrame(pdf), ["a", "b"], models.decision_tree(1, 32), scaler=None).stages[-1]

    def gini(y):
        return 2 * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def impurity(c, t):
        left = pdf[c] <= t
        return left.mean() * gini(pdf.loc[left, "label"]) + (~left).mean() * gini(pdf.loc[~left, "label"])

    best = min(((impurity(c, t), c) for c in ("a", "b") for t in range(11)))
    root = tree._java_obj.rootNode()
    got = ("a", "b")[root.split().featureIndex()]
    assert got == best[1] == "b" and impurity(got, root.split().threshold()) == pytest.approx(best[0])


def test_saved_model_scores_the_same(loans, tmp_path):
    model = models.fit(loans, COLS, models.gbt(5, 3))
    models.save(model, str(tmp_path / "m"))
    a = models.score(model, loans, COLS).orderBy("loan_id").toPandas()
    assert a.equals(models.score(models.load(str(tmp_path / "m")), loans, COLS).orderBy("loan_id").toPandas())


def test_cross_validation_uses_every_fold(planted):
    df, _ = planted
    folds = resample.kfold(df, "loan_id", 4)
    grid = {"regParam": [0.0, 5.0], "elasticNetParam": [0.0, 1.0]}
    best, t = search.cross_validate(folds, ["x0", "x1", "x2"], models.logistic(), grid, folds=4)
    rows = t.orderBy("combo").collect()
    assert len(rows) == 4 and folds.select("fold").distinct().count() == 4
    assert best.stages[-1].getRegParam() in (0.0, 5.0) and max(r["avg_metric"] for r in rows) > 0.95
    assert min(r["avg_metric"] for r in rows) == 0.5  # a penalty of 5 with l1 leaves a constant
    aucs = search.kfold_auc(folds, ["x0", "x1", "x2"], lambda: models.logistic(), 4, scaler="minmax",
                            rebalance=lambda tr: resample.upsample(tr, "loan_id").drop("draw"))
    assert len(aucs) == 4 and min(aucs) > 0.9


def test_proposals_come_from_the_good_trials():
    space = {"a": ("uniform", 0.0, 1.0), "b": ("randint", 0, 100)}
    trials = [{"a": i / 40, "b": 2 * i, "loss": abs(i / 40 - 0.2)} for i in range(40)]
    model = search.propose(trials, space, 10, seed=1)
    blind = search.propose(trials[:3], space, 10, seed=1)
    assert model != blind
    assert np.mean([abs(p["a"] - 0.2) for p in model]) < 0.15 < np.mean([abs(p["a"] - 0.2) for p in blind])


def test_boruta_confirms_and_rejects(planted):
    df, _ = planted
    dec, hist = explain.boruta(df, "loan_id", [f"x{i}" for i in range(6)], max_rounds=25, trees=10, depth=4)
    got = {r["feature"]: r["decision"] for r in dec.collect()}
    assert got["x0"] == got["x1"] == "Confirmed" and "Rejected" in got.values()
    per = {r["feature"]: r["n"] for r in hist.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(per[r["feature"]] == r["decided_in"] for r in dec.filter("decision = 'Rejected'").collect())  # they left the race
    st = dec.filter("feature = 'x0'").first()
    assert st["min_imp"] <= st["median_imp"] <= st["max_imp"] and st["hit_share"] == 1.0


def test_staged_auc_is_that_of_the_shorter_model(planted):
    df, _ = planted
    cols = ["x0", "x1", "x2"]
    stages = search.staged_auc(models.fit(df, cols, models.gbt(6, 2), scaler=None), df, cols)
    short = models.score(models.fit(df, cols, models.gbt(3, 2), scaler=None), df, cols).withColumn("g", F.lit(1))
    assert len(stages) == 6 and stages[2] == pytest.approx(ev.auc(short, ["g"]).first()["auc"], abs=1e-9)


def test_boosting_rounds_stop_after_the_best(planted):
    df, _ = planted
    rows = search.boosting_rounds(resample.kfold(df, "loan_id", 2), ["x0", "x1"], 2, 0.3, max_rounds=40, patience=4, folds=2)
    best = next(i for i, r in enumerate(rows) if r[2])
    assert rows[best][1] == max(r[1] for r in rows) and (len(rows) == 40 or len(rows) - 1 - best >= 4)


def test_sweep_keeps_two_to_all_but_one(planted):
    df, _ = planted
    rows = explain.importance_sweep(df, ["x0", "x1", "x2"], iters=3, depth=2).collect()
    assert {r["n_features"] for r in rows} >= {1, 2} and all(2 <= r["n_features"] < 3 for r in rows if r["best"])


def test_permutation_importance(planted):
    df, _ = planted
    cols = [f"x{i}" for i in range(6)]
    model = models.fit(df, cols, models.logistic(0.0, 0.0, 50))
    w = {r["feature"]: r["weight"] for r in explain.permutation_importance(model, df, "loan_id", cols, repeats=2).collect()}
    assert w["x0"] > w["x1"] > 0.05 and max(abs(w[f"x{i}"]) for i in range(2, 6)) < 0.03
    copies = explain.permuted_copies(df, "loan_id", cols, repeats=1).filter("perm_feature = 'x3'").toPandas().set_index("loan_id")
    own = df.toPandas().set_index("loan_id")
    assert sorted(copies["x3"]) == sorted(own["x3"]) and (copies.loc[own.index, "x3"] != own["x3"]).mean() > 0.9
    assert (copies.loc[own.index, "x0"] == own["x0"]).all()


def test_lime_ranks_a_linear_model(planted):
    df, _ = planted
    cols = [f"x{i}" for i in range(6)]
    model = models.fit(df, cols, models.logistic(0.1, 0.0, 50))
    near = models.score(model, df, cols).filter("abs(score - 0.5) < 0.2").limit(6).select("loan_id")
    out = explain.lime(model, df, df.join(near, "loan_id", "left_semi"), "loan_id", cols, n_samples=400, top=2).toPandas()
    first = out[out["rank"] == 1]
    assert len(first) == 6 and (first["feature"] == "x0").mean() > 0.8 and (first["weight"] > 0).all()


def test_linear_contributions_add_up_to_the_margin(planted):
    df, pdf = planted
    cols = [f"x{i}" for i in range(6)]
    model = models.fit(df, cols, models.logistic(0.01, 0.0, 50))
    c = explain.linear_contributions(model, df, df, "loan_id", cols).groupBy("loan_id").agg(F.sum("contribution").alias("c")).toPandas()
    s = models.score(model, df, cols).toPandas().merge(c, on="loan_id")
    margin = np.log(s["score"] / (1 - s["score"]))
    assert np.allclose(margin - margin.mean(), s["c"] - s["c"].mean(), atol=1e-6)


@pytest.mark.parametrize(("right", "n", "nir"), [(80, 100, 0.7), (0, 12, 0.5), (12, 12, 0.5), (430, 500, 0.88)])
def test_accuracy_tests_match_binomial_sums(right, n, nir):
    def at_least(k, p):
        return sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k, n + 1))
    low, high, p_acc, _ = ev.accuracy_tests(right, n, nir, 3, 9)
    assert p_acc == pytest.approx(at_least(right, nir), abs=1e-9)
    assert (low == 0 if right == 0 else at_least(right, low) == pytest.approx(0.025, abs=1e-9))
    assert (high == 1 if right == n else 1 - at_least(right + 1, high) == pytest.approx(0.025, abs=1e-9))
    assert ev.accuracy_tests(right, n, nir, 3, 9)[3] == pytest.approx(math.erfc(math.sqrt((abs(3 - 9) - 1) ** 2 / 12 / 2)))


def test_vif_of_eleven_columns_matches_regression(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 11)) + 1e6  # a large mean must not cancel
    x[:, 10] = x[:, :3].sum(axis=1) + 0.5 * rng.normal(size=500)
    cols = [f"c{i}" for i in range(11)]
    v = corr.vif_elimination(spark.createDataFrame(pd.DataFrame(x, columns=cols)), cols, threshold=1e9, centered=True).toPandas()
    for i, c in enumerate(cols):
        z = x - x.mean(axis=0)
        others = np.delete(z, i, axis=1)
        resid = z[:, i] - others @ np.linalg.lstsq(others, z[:, i], rcond=None)[0]
        assert v.loc[v["feature"] == c, "vif"].iloc[0] == pytest.approx((z[:, i] ** 2).sum() / (resid ** 2).sum(), rel=1e-6)


def test_boruta_rounds_run_together_only_where_no_decision_can_interfere():
    adj = 0.05 / 19
    assert explain.rounds_until_decided([0] * 19, 0, adj) == 9  # 2^-9 is the first tail below
    assert explain.rounds_until_decided([0, 4], 8, adj) == 1  # the next may reject the first
    for hits, r in (([5], 9), ([6, 3], 10), ([11], 20)):
        k = explain.rounds_until_decided(hits, r, adj)
        sf = explain._binom_sf
        may = lambda h, j: sf(r + j - h, r + j) < adj
        assert not any(may(h, j) for h in hits for j in range(1, k))
        assert any(may(h, k) for h in hits) or all(may(h, j) or sf(h + j, r + j) < adj for h in hits for j in (k,))
