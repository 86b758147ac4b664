"""Invariants and hand-computed tables for the row-only operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import clean, corr, evaluate as ev, resample, trials
from riskframe.functions.columns import legal_names

SF_SMALL = "/root/testdata/sf0.001"


def test_rates_zero_guards(spark):
    # one-class labels, no positive predictions: precision/recall/f1 fall back to 0
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 0)], "label int, prediction int")
    r = ev.rates(ev.confusion(df)).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_auc_with_ties_hand_table(spark):
    # pos scores 0.8, 0.5 ; neg scores 0.5, 0.2 -> pairs: (0.8>0.5)=1, (0.8>0.2)=1, (0.5=0.5)=.5, (0.5>0.2)=1
    df = spark.createDataFrame([(1, 0.8), (1, 0.5), (0, 0.5), (0, 0.2)], "label int, score double")
    a = ev.auc(df.withColumn("g", F.lit(1)), ["g"]).first()["auc"]
    assert a == 3.5 / 4


def test_curves_end_at_one(spark):
    df = spark.createDataFrame([(1, 0.8), (1, 0.5), (0, 0.5), (0, 0.2)], "label int, score double")
    c = ev.curves(df.withColumn("g", F.lit(1)), ["g"]).orderBy(F.col("threshold").desc()).collect()
    assert (c[-1]["fpr"], c[-1]["tpr"]) == (1.0, 1.0)
    assert c[0]["precision"] == 1.0


def test_confusion_sums_to_total(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "label int, prediction int")
    r = ev.confusion(df).first()
    assert r["tp"] + r["tn"] + r["fp"] + r["fn"] == r["total"] == 5


def test_legal_names_like_r():
    assert legal_names(["term_ 60 months", "a", "a", "1x", "_y"]) == ["term_.60.months", "a", "a.1", "X1x", "X_y"]


def test_blank_to_null_keeps_leading_space(spark):
    df = spark.createDataFrame([("   ", " 60 months"), ("", "x")], "a string, b string")
    r = clean.blank_to_null(df).collect()
    assert r[0]["a"] is None and r[1]["a"] is None and r[0]["b"] == " 60 months"


def test_kfold_partitions_keys(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    f = resample.kfold(df, "k", 5).toPandas()
    assert f["fold"].between(0, 4).all() and f["k"].is_unique and len(f) == 1000
    assert f["fold"].value_counts().min() > 150


def test_upsample_parity_and_membership(spark):
    pdf = pd.DataFrame({"k": np.arange(300), "label": (np.arange(300) % 7 == 0).astype(int)})
    out = resample.upsample(spark.createDataFrame(pdf), "k").toPandas()
    assert (out["label"] == 1).sum() == (out["label"] == 0).sum()
    assert set(out.loc[out["label"] == 1, "k"]) <= set(pdf.loc[pdf["label"] == 1, "k"])


def test_stratified_partition_shares(spark):
    pdf = pd.DataFrame({"k": np.arange(1000), "label": (np.arange(1000) % 4 == 0).astype(int)})
    out = resample.stratified_partition(spark.createDataFrame(pdf), "k").toPandas()
    assert (out.query("label == 1")["part"] == "a").sum() == 225   # ceil(0.9 * 250)
    assert (out.query("label == 0")["part"] == "a").sum() == 675   # ceil(0.9 * 750)


def test_trial_log_blank_lines(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("loss,params,iteration,train_time\n"
                 "0.3,\"{'a': 1}\",0,1.5\n\n0.2,\"{'a': 2}\",1,2.5\n\n")
    from riskframe.sources.trial_logs import read_log_a
    t = read_log_a(spark, str(p))
    rows = trials.parse_params(t, "params", ["a"], {"a": "int"}).orderBy("iteration").collect()
    assert [r["a"] for r in rows] == [1, 2]


def test_parse_params_booleans_quotes_and_nested(spark):
    text = "{'a': True, 'b': None, 'c': 'None of True', 'd': {'x': 1, 'y': False}, 'e': False}"
    df = spark.createDataFrame([(text,)], "params string")
    r = trials.parse_params(df, "params", ["a", "b", "c", "d.x", "d.y", "e"],
                            {"a": "boolean", "d.x": "int", "d.y": "boolean", "e": "boolean"}).first()
    assert (r["a"], r["b"], r["c"], r["d.x"], r["d.y"], r["e"]) == (True, None, "None of True", 1, False, False)


def test_quniform_steps_above_one(spark):
    from riskframe.operators.search import sample_space
    space = {"a": ("quniform", 5, 50, 5), "b": ("quniform", 0, 64, 16), "c": ("quniform", 0.0, 1e-6, 5e-8),
             "d": ("quniform", 100, 1000, 100), "e": ("choice_of", {"x": {"k": ("randint", 1, 3)}, "y": {}})}
    t = sample_space(spark.range(3000).withColumnRenamed("id", "i"), "i", space).toPandas()
    assert sorted(t["a"].unique()) == [5.0 * i for i in range(1, 11)]
    assert sorted(t["b"].unique()) == [0, 16, 32, 48, 64]
    assert t["c"].nunique() == 21 and t["d"].nunique() == 10
    assert t.loc[t["e"] == "y", "k"].isna().all() and set(t.loc[t["e"] == "x", "k"]) == {1, 2, 3}


def test_mv_sis_with_three_classes(spark):
    from riskframe.operators.select import mv_sis
    rng = np.random.default_rng(8)
    n = 240
    pdf = pd.DataFrame({"x": rng.integers(0, 30, n).astype(float), "label": rng.integers(0, 3, n)})
    pdf["x"] += 5 * pdf["label"]
    got = mv_sis(spark.createDataFrame(pdf), ["x"]).first()
    x, y = pdf["x"].to_numpy(), pdf["label"].to_numpy()
    cdf = [[(x[y == r] <= v).mean() for v in x] for r in range(3)]
    whole = np.array([(x <= v).mean() for v in x])
    mv = sum((y == r).mean() * ((np.array(cdf[r]) - whole) ** 2).mean() for r in range(3))
    kf = max(np.abs(np.array(cdf[a]) - np.array(cdf[b])).max() for a in range(3) for b in range(a))
    assert abs(got["mv"] - mv) < 1e-12 and abs(got["kf"] - kf) < 1e-12


def test_auc_of_large_counts_does_not_overflow(spark):
    from unittest import mock
    counts = spark.createDataFrame([(1, 0.2, 0, 5_000_000_000), (1, 0.8, 5_000_000_000, 0)], "g int, score double, n_pos long, n_neg long")
    with mock.patch.object(ev, "_score_counts", return_value=counts):
        assert ev.auc(counts, ["g"]).first()["auc"] == 1.0


def test_unlabelled_rows_are_in_no_part(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(100)], "k long, label int")
    out = resample.stratified_partition(df, "k").toPandas()
    assert out.loc[out["label"].isna(), "part"].isna().all() and out.loc[out["label"].notna(), "part"].notna().all()


def test_split_share_is_not_rounded(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    n = resample.train_test_split(df, "k", 0.125).filter("split = 'train'").count()
    assert abs(n - 2500) < 150


def test_duration_parse(spark):
    df = spark.createDataFrame([("0 days 00:01:35.349002",)], "d string")
    v = df.select(trials.duration_seconds(F.col("d")).alias("s")).first()["s"]
    assert abs(v - 95.349002) < 1e-9


def test_vif_centered_at_least_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    x[:, 2] = x[:, 0] + 0.1 * rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    v = corr.vif_elimination(df, ["a", "b", "c"], threshold=5.0, centered=True).toPandas()
    assert (v["vif"] >= 1 - 1e-9).all()
    assert v.query("round == 0 and dropped")["feature"].iloc[0] in ("a", "c")


def test_pca_contrib_sums_to_100(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(300, 4)), columns=list("abcd")))
    comps, var = corr.pca(df, list("abcd"))
    s = var.groupBy("component").agg(F.sum("contrib").alias("s")).toPandas()
    assert np.allclose(s["s"], 100.0)
    assert abs(comps.agg(F.sum("variance_share")).first()[0] - 1.0) < 1e-9


def test_shapley_additivity(spark):
    from riskframe.operators import explain, models
    rng = np.random.default_rng(9)
    n = 300
    pdf = pd.DataFrame({"loan_id": np.arange(n), "a": rng.normal(size=n), "b": rng.normal(size=n)})
    pdf["label"] = (pdf["a"] + 0.5 * pdf["b"] + 0.3 * rng.normal(size=n) > 0).astype(int)
    df = spark.createDataFrame(pdf)
    m = models.fit(df, ["a", "b"], models.logistic(0.0, 0.0, 50))
    rows = df.filter("loan_id < 5")
    phi, _ = explain.shapley(m, df, rows, "loan_id", ["a", "b"], permutations=6)
    s = phi.groupBy("loan_id").agg(F.sum("phi").alias("s")).toPandas().set_index("loan_id")["s"]
    fx_ = models.score(m, rows, ["a", "b"]).toPandas().set_index("loan_id")["score"]
    # mean background prediction over the same md5-picked background rows
    from riskframe.functions.rand import b, b60
    from riskframe.plans.prefix import rank_within
    bg = rank_within(df.withColumn("_h", b("shapbg", F.col("loan_id"))), [], ["_h", "loan_id"], out="_bi", base=0)
    em = rows.select("loan_id").withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(5))))
    ek = F.concat(F.col("loan_id").cast("string"), F.lit(":"), F.col("_m").cast("string"))
    em = em.withColumn("_bi", b60("shappick", ek) % n)
    picks = em.join(bg.select("_bi", F.col("loan_id").alias("bg_id")), "_bi")
    bsc = models.score(m, df, ["a", "b"]).select(F.col("loan_id").alias("bg_id"), F.col("score").alias("f_bg"))
    base = picks.join(bsc, "bg_id").groupBy("loan_id").agg(F.avg("f_bg").alias("base")).toPandas().set_index(
        "loan_id")["base"]
    for k in s.index:
        assert abs(s[k] - (fx_[k] - base[k])) < 1e-9


def test_binned_density_is_within_its_bound(spark):
    import numpy as np
    from riskframe.operators import profile
    rng = np.random.default_rng(8)
    rows = [(float(x), "a") for x in rng.normal(size=3000)] + [(float(x), "b") for x in rng.gamma(0.5, 40, size=500)] + [(7.0, "c")] * 5 + [(None, "a")]
    df = spark.createDataFrame(rows, "x double, g string")
    exact = profile.kde(df, "x", "g").toPandas().sort_values(["g", "grid_i"])
    for cells in (64, 4096):
        got = profile.kde_binned(df, "x", "g", cells=cells).toPandas().sort_values(["g", "grid_i"])
        gap = np.abs(got["density"].to_numpy() - exact["density"].to_numpy())
        assert set(got["g"]) == {"a", "b"} and np.allclose(got["x"], exact["x"]) and (gap <= got["bound"].to_numpy() + 1e-12).all()
        assert cells == 64 or got.loc[got["g"] == "a", "bound"].max() < 1e-4


def test_a_continuous_label_is_refused(spark):
    from riskframe.operators.select import mv_sis
    df = spark.range(300).selectExpr("cast(id as double) AS x", "cast(id as double) / 7 AS label")
    with pytest.raises(ValueError, match="class label"):
        mv_sis(df, ["x"])
    assert mv_sis(df.selectExpr("x", "cast(x as int) % 3 AS label"), ["x"]).count() == 1
