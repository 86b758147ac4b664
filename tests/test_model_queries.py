"""Registered model queries at the smallest scale, held against numpy or against what they are made of."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe import catalog as c
from riskframe.operators import explain, models, resample, search

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    m, train, test, feats = c._split_model(spark, SF)
    return train.toPandas(), test.toPandas(), feats


@pytest.fixture(scope="module")
def run(spark):
    known = {}

    def get(name):
        if name not in known:
            known[name] = c.queries()[name](spark, SF).toPandas()
        return known[name]
    return get


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))


def by_split(t):
    return t.set_index("split")


@pytest.mark.parametrize(("name", "make", "scaler"), [
    ("M4", lambda: models.logistic(0.0, 0.0, 50), "standard"), ("M7", lambda: models.linear_svc(0.0, 100), "minmax"),
    ("M9", lambda: models.random_forest(10, 5), "minmax"), ("M10", lambda: models.gbt(10, 5), "minmax")])
def test_evaluation_is_that_of_the_fitted_model(spark, run, split, name, make, scaler):
    train, test, feats = split
    got = by_split(run(name))
    model = models.fit(spark.createDataFrame(train), feats, make(), scaler=scaler)
    for part, pdf in (("train", train), ("test", test)):
        s = models.score(model, spark.createDataFrame(pdf), feats).toPandas().merge(pdf[["loan_id", "label"]], on="loan_id", suffixes=("", "_own"))
        assert got.loc[part, "total"] == len(pdf) and (s["label"] == s["label_own"]).all()
        # another order of the rows may move a fit in its last digits, not its ranking
        assert got.loc[part, "accuracy"] == pytest.approx((s["prediction"] == s["label"]).mean(), abs=0.02)
        assert got.loc[part, "auc"] == pytest.approx(auc(s["label"].to_numpy(), s["score"].to_numpy()), abs=0.05)
        assert got.loc[part, ["tp", "tn", "fp", "fn"]].sum() == len(pdf)


def test_naive_bayes_equals_gaussian_formulas(run, split):
    train, test, feats = split
    x, y = train[feats].to_numpy(float), train["label"].to_numpy()
    lo, width = x.min(axis=0), x.max(axis=0) - x.min(axis=0)
    scale = lambda z: np.where(width > 0, (z - lo) / np.where(width > 0, width, 1), 0.5)
    z, eps = scale(x), 1e-9
    eps *= z.var(axis=0).max()

    def log_odds(w):
        out = []
        for k in (0, 1):
            own = z[y == k]
            var = own.var(axis=0) + eps
            out.append(np.log((len(own) + 1) / (len(z) + 2)) - 0.5 * (np.log(2 * np.pi * var) + (w - own.mean(axis=0)) ** 2 / var).sum(axis=1))
        return out[1] - out[0]

    got = by_split(run("M16"))
    for part, pdf in (("train", train), ("test", test)):
        want = (log_odds(scale(pdf[feats].to_numpy(float))) > 0).astype(int)
        assert got.loc[part, "accuracy"] == pytest.approx((want == pdf["label"]).mean(), abs=0.01)


def test_fold_aucs_refit_the_scaler(spark, run, split):
    train, _, feats = split
    folds = resample.kfold(spark.createDataFrame(train), "loan_id", 3).toPandas()
    got = run("M4_folds").sort_values("fold")["auc"].tolist()
    for f, value in enumerate(got):
        inner = spark.createDataFrame(folds[folds["fold"] != f].drop(columns="fold"))
        out = spark.createDataFrame(folds[folds["fold"] == f].drop(columns="fold"))
        s = models.score(models.fit(inner, feats, models.logistic(0.0, 0.0, 50), scaler="standard"), out, feats).toPandas()
        assert value == pytest.approx(auc(s["label"].to_numpy(), s["score"].to_numpy()), abs=1e-3)


def test_importances_and_coefficients(run, split):
    train, _, feats = split
    imp = run("M17")
    assert imp["importance"].sum() == pytest.approx(1, abs=1e-4) and (imp["importance"].diff().dropna() <= 0).all() and len(imp) == len(feats)
    coef = run("M18")
    assert len(coef) == len(feats) + 1 and "(intercept)" in set(coef["feature"])
    assert (coef["coefficient"].abs().diff().dropna() <= 1e-9).all()
    f1 = run("F1")
    assert f1["importance"].sum() == pytest.approx(1, abs=1e-4)


def test_training_job_reports_its_own_fit(run, split):
    train, _, _ = split
    t = run("M19")
    assert set(t["penalty"]) == {"l2"} and t["reg_param"].iloc[0] == pytest.approx(1 / len(train), abs=1e-6)


def test_screened_forest_uses_fewer_features(run):
    t = by_split(run("F15"))
    assert set(t.index) == {"train", "test"} and t.loc["train", "auc"] > 0.55
    kept = run("F9")
    assert 0 < len(kept) < len(run("F7"))


def test_group_lasso_grid_equals_separate_descents(spark, run):
    got = run("F6").sort_values("tol", ascending=False)
    assert len(got) == 6 and set(got["folds"]) == {5}
    m = c.fx.loans_model(spark, SF)
    feats = c.model_features(m)
    d = resample.kfold(m.select("loan_id", "label", *[c.q(f) for f in feats]), "loan_id", 5, salt="gl").persist()
    acc = []
    for f in range(5):
        path, scaling = explain.lasso_path(d.filter(F.col("fold") != f), feats, c._groups(feats), c.F5_REG, 0.0, 3000, 1e-2)
        own = d.filter(F.col("fold") == f).agg(F.avg(((explain._margin(path[-1][0], feats, scaling) > 0).cast("int") == F.col("label")).cast("double"))).first()[0]
        acc.append(own)
    d.unpersist()
    assert got.loc[got["tol"] == 1e-2, "cv_accuracy"].iloc[0] == pytest.approx(np.mean(acc), abs=1e-6)


def test_holdout_metrics(spark):
    rng = np.random.default_rng(9)
    y, s = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    t = spark.createDataFrame([(int(a), float(b), int(b > 0.5)) for a, b in zip(y, s)], "label int, score double, prediction int")
    got = search.holdout_metrics(t)
    p = s > 0.5
    tp, fp, fn, tn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum(), (~p & (y == 0)).sum()
    f1 = [2 * a / (2 * a + fp + fn) for a in (tn, tp)]
    assert got["auroc"] == pytest.approx(auc(y, s)) and got["recall"] == pytest.approx(tp / (tp + fn)) and got["precision"] == pytest.approx(tp / (tp + fp))
    assert got["f1_weighted"] == pytest.approx((f1[0] * (y == 0).sum() + f1[1] * (y == 1).sum()) / 300)
    assert got["roc_weighted"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)


def test_search_queries_hold_together(run):
    trials = run("H5")
    assert len(trials) == 20 and trials["iteration"].tolist() == list(range(20))
    assert trials["maxDepth"].between(2, 6).all() and trials["maxIter"].between(5, 20).all() and trials["stepSize"].between(0.01, 0.5).all()
    assert (trials["end_s"] >= trials["start_s"]).all() and trials["loss"].between(0, 1).all()
    times = run("H12")
    assert len(times) == 8 and ((times["end"] - times["start"]).dt.total_seconds() - times["seconds"]).abs().max() < 0.01
    more = run("H9")
    assert more["iteration"].tolist() == list(range(10, 20))  # the study goes on where its log ends


def test_whole_metric_matrix_of_models(run, spark):
    t = run("E10_models")
    assert {"accuracy", "precision", "recall", "f1", "auc"} <= set(t.columns) and t["total"].min() > 0
    for _, r in t.iterrows():
        assert r["accuracy"] == pytest.approx((r["tp"] + r["tn"]) / r["total"], abs=1e-6)


def test_binomial_decisions_over_long_histories(spark):
    """Many rounds: the tail is not summed from numbers as long as the history."""
    from fractions import Fraction
    from math import comb
    from riskframe.operators import explain
    for n, k in ((1500, 700), (1500, 750), (1500, 815), (1500, 1500)):
        exact = float(Fraction(sum(comb(n, i) for i in range(k, n + 1)), 2 ** n))
        assert explain._binom_sf(k, n) == pytest.approx(exact, rel=1e-9)
    n = 200_000
    one = spark.range(n).select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("id") < h).alias("hit"), F.lit(m).alias("importance"), F.lit(0.5).alias("max_shadow"))
                                                    for f, h, m in (("a", 101_500, 0.9), ("b", 98_500, 0.1), ("c", 100_100, 0.7), ("d", 99_900, 0.2))])).alias("s")).select("s.*")
    dec = explain.binomial_decisions(one)
    assert {r["feature"]: (r["rounds"], r["hits"], r["decision"]) for r in dec.collect()} == {
        "a": (n, 101_500, "Confirmed"), "b": (n, 98_500, "Rejected"), "c": (n, 100_100, "Tentative"), "d": (n, 99_900, "Tentative")}
    assert {r["feature"]: r["final"] for r in explain.tentative_fix(dec, one).collect()} == {"a": "Confirmed", "b": "Rejected", "c": "Confirmed", "d": "Rejected"}


def test_fits_read_evenly_dealt_rows(spark, tmp_path, monkeypatch):
    """A table of many loans is spread over the cores; a small one stays as it is, and no row is lost."""
    spark.range(1, 2001).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    loans = spark.range(1, 2001).coalesce(1).select(F.col("id").alias("loan_id"))
    assert c._dealt(spark, str(tmp_path), loans).rdd.getNumPartitions() == 1
    monkeypatch.setattr(c, "DEALT_ROWS", 500)
    parts = c._dealt(spark, str(tmp_path), loans).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 2000 and max(r["count"] for r in parts) < 650
