"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator ID.

Every query reads the TESTDATA tables (through the fixtures, which are
pure functions of them), so its work grows with the scale factor.
Doubles are rounded to 6 dp at the end so results hash the same as the
DuckDB oracle in ``riskframe.checks.oracle``.
"""

from __future__ import annotations

import math
import threading
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
import numpy as np

from riskframe.functions.columns import q
from riskframe.operators import clean, corr, evaluate as ev, profile, resample, select, trials
from riskframe.sources import fixtures as fx
from riskframe.sources import tables
from riskframe.session import cut_lineage

CONT = ["loan_amnt", "funded_amnt", "installment", "int_rate", "annual_inc", "n_items", "avg_disc"]
STRING_RAW = ["term", "grade", "home_ownership", "initial_list_status", "hardship_flag", "title",
              "loan_status"]
TRIAL_PARAMS = ["learning_rate", "max_depth", "n_neighbors", "subsample", "reg_lambda"]
EVAL_KEYS = ["model", "split"]
F14_SELECTED = ["int_rate", "term_ 60 months", "grade_B", "grade_C", "grade_D", "grade_E"]
F14_EXTRA = ["hardship_flag", "home_ownership_RENT"]
F10_TRUE = (1, 5, 9)
F10_NOBS = 50
KNN_KS = (3, 5, 10, 25, 50)
KNN_METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski")
DEALT_ROWS = 20_000
LARGEST_DEALT = 500_000
BOOSTING_CODES = {"gbdt": 0, "dart": 1, "goss": 2}


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[
        F.round(q(f.name), digits).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else q(f.name) for f in df.schema.fields])


def model_features(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("loan_id", "label")]


# ---------------------------------------------------------------- P: cleaning
def p1(s, d):
    return clean.blank_to_null(fx.loans_raw(s, d)).select("loan_id", *STRING_RAW)


def p2(s, d):
    return clean.drop_sparse_columns(clean.blank_to_null(fx.loans_raw(s, d)), 0.05)


def p3(s, d):
    before = clean.blank_to_null(fx.loans_raw(s, d))
    return clean.dropped_columns(before, clean.drop_sparse_columns(before, 0.05))


def p4(s, d):
    return clean.select_by_type(fx.loans_raw(s, d), "numeric")


def p5(s, d):
    return clean.drop_columns(fx.loans_raw(s, d), ["issue_d", "title"])


def p6(s, d):
    return clean.complete_cases(fx.loans_raw(s, d), fx.COMPLETE_CASE_COLS).select("loan_id", *CONT)


def p7(s, d):
    return clean.count_incomplete(clean.blank_to_null(fx.loans_raw(s, d)))


def p8(s, d):
    return clean.recode_status(fx.loans_raw(s, d).select("loan_id", "loan_status"))


def p8_unmatched(s, d):
    """Status texts without a label, and how many loans have them (here: the two last texts are taken out of the map)."""
    known = dict(list(clean.STATUS_TO_LABEL.items())[:-2])
    return clean.unmatched_status(fx.loans_raw(s, d), mapping=known)


def p9(s, d):
    return clean.recode_levels(fx.loans_raw(s, d).select("loan_id", *fx.FLAG_MAPS), fx.FLAG_MAPS)


def p10(s, d):
    return clean.one_hot(fx.loans_raw(s, d).select("loan_id", *fx.ONE_HOT_COLS), fx.ONE_HOT_COLS, True)


def p11(s, d):
    return clean.one_hot(fx.loans_raw(s, d).select("loan_id", "home_ownership"), ["home_ownership"], False)


def p12(s, d):
    return clean.distinct_rows(fx.loans_raw(s, d).select("grade", "term", "home_ownership", "hardship_flag"))


def p13(s, d):
    return clean.sample_n(fx.loans_raw(s, d).select("loan_id", "loan_amnt"), 500, "loan_id")


def p14(s, d):
    m = fx.loans_model(s, d)
    left = m.select("loan_id", *CONT)
    right = m.select("loan_id", "label")
    return clean.concat_columns(left, right, "loan_id")


def p15(s, d):
    m = fx.loans_model(s, d).select("loan_id", "label")
    zero, one = clean.split_by_class(m)
    return clean.union_rows(zero.withColumn("part", F.lit("zero")), one.withColumn("part", F.lit("one")))


def p16(s, d):
    return clean.split_by_class(fx.loans_model(s, d).select("loan_id", "label"))[1]


def p17(s, d):
    return clean.legalize_names(fx.loans_model(s, d))


def p18(s, d):
    m = fx.loans_model(s, d).withColumnRenamed("label", "loan_status")
    return clean.label_features(m, "loan_status")


def p19(s, d):
    return clean.preview(fx.loans_raw(s, d).select("loan_id", *CONT), "loan_id", 5)


def p20(s, d):
    return clean.shuffle_rows(fx.loans_raw(s, d).select("loan_id"), "loan_id")


def p21(s, d):
    return clean.threshold_decision(fx.scores(s, d).drop("prediction"), "score", "prediction", 0.5, 2)


def p22(s, d):
    return clean.rename_columns(fx.trials_c(s, d).select("iteration", "value", "datetime_start", "state"),
                                {"value": "f1_weighted", "datetime_start": "start", "iteration": "number"})


# ---------------------------------------------------------------- A: profiling
def a1(s, d):
    return profile.quality_table(clean.blank_to_null(fx.loans_raw(s, d)))


def a2(s, d):
    return profile.value_counts(fx.loans_raw(s, d), "loan_status")


def a3(s, d):
    return profile.shape(fx.loans_raw(s, d))


def a4(s, d):
    m = fx.loans_model(s, d)
    return profile.column_summary(m, model_features(m))


def a5(s, d):
    return profile.histogram(fx.loans_model(s, d), CONT, bins=10)


def a6(s, d):
    return profile.histogram(fx.loans_model(s, d), CONT, bins=10, by="label")


def a7(s, d):
    return profile.kde_all(fx.loans_model(s, d), CONT, by="label", grid=64)


def a7_binned(s, d):
    return profile.kde_all(fx.loans_model(s, d), CONT, by="label", grid=64, binned=True)


def a8(s, d):
    return profile.box_stats(fx.loans_model(s, d), CONT, by="label")


def a9(s, d):
    m = fx.loans_model(s, d)
    return profile.level_counts(m, [c for c in model_features(m) if "_" in c and c not in CONT
                                    and c not in ("policy_code",)])


def a10(s, d):
    m = fx.loans_model(s, d)
    return profile.profile(m.select(*model_features(m)))


def a11(s, d):
    return profile.qq_points(fx.loans_model(s, d), "int_rate", "loan_id", n=1000)


def a12(s, d):
    m = fx.loans_model(s, d)
    return profile.drop_zero_variance(m, model_features(m))


def a13(s, d):
    return profile.levels_by_frequency(fx.loans_raw(s, d), ["term", "grade", "home_ownership", "loan_status"])


def a14(s, d):
    return profile.schema_report(loans_raw=fx.loans_raw(s, d), loans_model=fx.loans_model(s, d))


def a14_diff(s, d):
    rep = profile.schema_report(loans_raw=fx.loans_raw(s, d), loans_model=fx.loans_model(s, d))
    return profile.schema_diff(rep, "loans_raw", "loans_model")


def a4_levels(s, d):
    return profile.level_summary(fx.loans_raw(s, d), STRING_RAW)


def a10_full(s, d):
    raw = clean.blank_to_null(fx.loans_raw(s, d)).drop("issue_d")
    return profile.full_profile(raw, "loan_id", top=5)


# ---------------------------------------------------------------- C: correlation
def _spearman(s, d):
    m = fx.loans_model(s, d)
    return corr.spearman(m, "loan_id", model_features(m))


def c1(s, d):
    return _spearman(s, d)


def c2(s, d):
    return corr.top_pairs(_spearman(s, d), 10)


def c3(s, d):
    return corr.threshold_pairs(_spearman(s, d), 0.7)


def c4(s, d):
    m = fx.loans_model(s, d)
    return corr.vif_elimination(m, CONT + ["grade_B", "grade_C", "grade_D", "grade_E"],
                                threshold=5.0, centered=False)


def c5(s, d):
    m = fx.loans_model(s, d)
    return corr.pca(m, CONT)[0]


def c4_pairs(s, d):
    """VIF of every pair of continuous columns: 1 / (1 - r²)."""
    m = fx.loans_model(s, d)
    g, _, _ = corr.gram(m, CONT, True)
    pairs = [(i, j) for i in range(len(CONT)) for j in range(i + 1, len(CONT)) if {CONT[i], CONT[j]} != {"loan_amnt", "funded_amnt"}
             and "installment" not in (CONT[i], CONT[j])]
    rows = [(CONT[i], CONT[j], corr.vif_table(g[np.ix_([i, j], [i, j])], [CONT[i], CONT[j]], True)[0][1]) for i, j in pairs]
    return s.createDataFrame(rows, "feature_a string, feature_b string, vif double")


def c6_products(s, d):
    """Sum over components of coord_i · coord_j: all components together give back the correlation."""
    v = c6(s, d)
    a, b_ = (v.select("component", F.col("feature").alias(f"feature_{x}"), F.col("coord").alias(f"_{x}")) for x in "ab")
    return (a.join(b_, "component").filter("feature_a < feature_b").groupBy("feature_a", "feature_b")
            .agg(F.sum(F.col("_a") * F.col("_b")).alias("rho")))


def a11_sample(s, d):
    return a11(s, d).drop("theoretical_q")


def c6(s, d):
    m = fx.loans_model(s, d)
    return corr.pca(m, CONT)[1]


# ---------------------------------------------------------------- E: evaluation
def e1(s, d):
    return ev.confusion(fx.scores(s, d), EVAL_KEYS)


def e2(s, d):
    return ev.rates(ev.confusion(fx.scores(s, d), EVAL_KEYS))


def e3(s, d):
    return ev.classification_report(ev.confusion(fx.scores(s, d), EVAL_KEYS), EVAL_KEYS)


def e4(s, d):
    return ev.auc(fx.scores(s, d), EVAL_KEYS)


def e5(s, d):
    return ev.weighted_f1(ev.confusion(fx.scores(s, d), EVAL_KEYS), EVAL_KEYS)


def e6(s, d):
    return ev.hard_label_auc(ev.confusion(fx.scores(s, d), EVAL_KEYS), EVAL_KEYS)


def e7(s, d):
    return ev.roc_curve(fx.scores(s, d), EVAL_KEYS)


def e8(s, d):
    return ev.pr_curve(fx.scores(s, d), EVAL_KEYS)


def e9(s, d):
    return ev.test_error(fx.scores(s, d), EVAL_KEYS)


def e10(s, d):
    return ev.evaluation_matrix(fx.scores(s, d), EVAL_KEYS)


def e10_models(s, d):
    """Two models x two training sets (upsampled, SMOTE) x one test set, each loaded from its saved folder."""
    return ev.evaluation_matrix(_model_matrix(s, d), ["model", "train_set", "test_set"])


def _model_matrix(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    sets = {"upsampled": resample.upsample(train, "loan_id").select("label", *[q(c) for c in feats]),
            "smote": _loan_smote(s, d).select("label", *[q(c) for c in feats])}
    out = None
    for train_set, rows in sets.items():
        rows = rows.persist()
        kinds = {"logistic": models.logistic(0.0, 0.0, 50), "gbt": models.gbt(10, 3)}
        fits = _together([lambda est=est, rows=rows: models.fit(rows, feats, est) for est in kinds.values()])
        for name, model in zip(kinds, fits, strict=True):
            path = _scratch(s, f"model-{name}-{train_set}")
            models.save(model, path)
            scored = models.score(models.load(path), test, feats).select(
                F.lit(name).alias("model"), F.lit(train_set).alias("train_set"), F.lit("test").alias("test_set"), "*")
            out = scored if out is None else out.unionByName(scored)
        rows.unpersist()
    return out


def e11(s, d):
    return ev.sensitivity_specificity(ev.confusion(fx.scores(s, d), EVAL_KEYS), EVAL_KEYS)


def e12(s, d):
    return ev.metric_pairs(fx.scores(s, d), ["model"], "split")


def e13(s, d):
    return e13_tests(s, d).drop("accuracy_low", "accuracy_high", "accuracy_p", "mcnemar_p")


def e13_tests(s, d):
    return ev.confusion_statistics(ev.confusion(fx.scores(s, d), EVAL_KEYS), EVAL_KEYS)


# ---------------------------------------------------------------- F: screening
def _mv(s, d):
    m = fx.loans_model(s, d)
    return select.mv_sis(m, model_features(m))


def f7(s, d):
    return _mv(s, d).select("feature", "mv")


def f8(s, d):
    return _mv(s, d).select("feature", "kf")


def f9(s, d):
    return select.quantile_cutoff(_mv(s, d), "mv", 0.7)


def f10(s, d):
    return select.screening_evaluation(fx.rank_matrix(s, d), F10_TRUE, F10_NOBS)


def f10_rates(s, d):
    return select.selection_rates(fx.rank_matrix(s, d), F10_TRUE, F10_NOBS)


def _selected(s, d):
    mv = cut_lineage(_mv(s, d))  # one row per feature: pin it once for the three cut-offs
    a = select.quantile_cutoff(mv, "mv", 0.7).select(F.lit("mvsis").alias("method"), "feature")
    b = select.quantile_cutoff(mv, "kf", 0.7).select(F.lit("kolmogorov").alias("method"), "feature")
    c = select.quantile_cutoff(mv, "kf", 0.5).select(F.lit("kolmogorov_median").alias("method"), "feature")
    return a.unionByName(b).unionByName(c)


def f13(s, d):
    return select.method_differences(_selected(s, d))


def f14(s, d):
    return select.feature_set_union(fx.loans_model(s, d), F14_SELECTED, F14_EXTRA)


# ---------------------------------------------------------------- R: splits
def _train(s, d):
    m = fx.loans_model(s, d).select("loan_id", "label")
    return resample.train_test_split(m, "loan_id").filter(F.col("split") == "train").drop("split")


def r1(s, d):
    return resample.train_test_split(fx.loans_model(s, d).select("loan_id", "label"), "loan_id")


def r2(s, d):
    return resample.stratified_partition(fx.loans_model(s, d).select("loan_id", "label"), "loan_id")


def r3(s, d):
    return resample.upsample(_train(s, d), "loan_id")


def r5(s, d):
    return resample.kfold(fx.loans_model(s, d).select("loan_id", "label"), "loan_id", 5)


def r6(s, d):
    return resample.positional_split(fx.loans_model(s, d).select("loan_id"), "loan_id")


POINT = [f"x{i}" for i in range(1, 65)]


def _loan_smote(s, d, method="boxes"):
    """The training split of the loans, minority raised to parity over all features; the neighbours are exact."""
    m, train, _, feats = _split_model(s, d)
    onehot = [c for c in feats if m.schema[c].dataType.simpleString() == "int"]
    return resample.smote(train, "loan_id", feats, k=5, round_cols=onehot, method=method)


def r4(s, d):
    return _loan_smote(s, d)


def r4_pivot(s, d):
    """R4 with the neighbours found by pivots: the same rows."""
    return _loan_smote(s, d, "pivot")


def r4_pruning(s, d):
    """What the pivots spare on the loans' minority: query-shard pairs met and skipped, for every metric."""
    from riskframe.operators.knn import pruning
    m, train, test, feats = _split_model(s, d)
    minor = train.filter("label = 1")
    return pruning(minor, minor, "loan_id", "loan_id", feats, k=5, metrics=KNN_METRICS, exclude_self=True, chunk=64)


def r4_points(s, d):
    return resample.smote(fx.minority_points(s, d), "vec_id", POINT, k=5)


def _points(s, d):
    pts = fx.embedding_points(s, d)
    return pts.filter(F.col("split") == "train"), pts.filter(F.col("split") == "test")


def m14(s, d):
    from riskframe.operators.knn import knn_classify
    train, test = _points(s, d)
    return knn_classify(train, test, "vec_id", POINT, "label", k=5)


def m14_pivot(s, d):
    from riskframe.operators.knn import knn_classify
    train, test = _points(s, d)
    return knn_classify(train, test, "vec_id", POINT, "label", k=5, method="pivot")


def m14_grid(s, d):
    """Accuracy for the metrics and a spread of the k of the search space (3 to 50)."""
    from riskframe.operators.knn import knn_accuracy
    train, test = _points(s, d)
    return knn_accuracy(train, test, "vec_id", POINT, KNN_KS, KNN_METRICS, p=3.0)


# ---------------------------------------------------------------- M: models
_CALL = threading.local()  # ``held``: what a query's own call has persisted, see ``rounded``


def _hold(df: DataFrame) -> DataFrame:
    """Persist a table that several steps of the running query read; ``rounded`` lets go of it."""
    df = df.persist()
    if getattr(_CALL, "held", None) is not None:  # else the caller lets go of it
        _CALL.held.append(df)
    return df


def _together(tasks: list[Callable]) -> list:
    """Results of independent fits that run at the same time, each as its own jobs."""
    with ThreadPoolExecutor(max_workers=4) as ex:
        return list(ex.map(lambda f: f(), tasks))


def _dealt(s, d, loans: DataFrame) -> DataFrame:
    """The loans dealt evenly by rows: a fit makes many short passes, and after the joins a
    few large partitions would leave most cores idle. A table of one part stays as it is."""
    n = tables.table(s, d, "orders").count()  # of the files' footers
    parts = max(min(math.ceil(n / DEALT_ROWS), 2 * s.sparkContext.defaultParallelism), math.ceil(n / LARGEST_DEALT))
    return loans.repartition(parts, "loan_id") if parts > 1 else loans


def _split_model(s, d, mark: Callable[[DataFrame], DataFrame] | None = None):
    """Loans, train and test rows, features. ``mark`` adds columns that are drawn once and kept with the rows."""
    m = fx.loans_model(s, d)
    sp = resample.train_test_split(m, "loan_id")
    # every fit, scaler and score of the query reads this table
    sp = _hold(_dealt(s, d, mark(sp) if mark else sp))
    train = sp.filter(F.col("split") == "train").drop("split")
    test = sp.filter(F.col("split") == "test").drop("split")
    return m, train, test, model_features(m)


def _eval(model, train, test, feats, name):
    from riskframe.operators import models
    # counts and AUC both read the scores: a forest scores its rows once
    return ev.evaluation_matrix(_hold(models.scored_splits(model, train, test, feats, name)), ["model", "split"])


def m1(s, d):
    from pyspark.ml.functions import vector_to_array
    from riskframe.operators import models
    raw = fx.loans_raw(s, d)
    cols = ["loan_amnt", "installment", "int_rate", "annual_inc", "n_items", "avg_disc"]
    v = models.assembler(cols).transform(raw.select("loan_id", *cols))
    arr = vector_to_array("unscaledFeatures")
    return v.select("loan_id", *[arr[i].alias(c) for i, c in enumerate(cols)])


def _scaled(s, d, which):
    from pyspark.ml.functions import vector_to_array
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    tr, legal = models.safe_features(train, feats)
    te, _ = models.safe_features(test, feats)
    asm = models.assembler(legal)
    sc = models.minmax() if which == "minmax" else models.standard()
    fitted = sc.fit(asm.transform(tr))
    out = fitted.transform(asm.transform(te))
    arr = vector_to_array("scaledFeatures")
    return out.select("loan_id", *[arr[i].alias(c) for i, c in enumerate(legal)])


def m2(s, d):
    return _scaled(s, d, "minmax")


def m3(s, d):
    return _scaled(s, d, "standard")


def m4(s, d):
    """Pipeline: assembler + standard scaler + estimator fitted together, scored on both splits."""
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return _eval(models.fit(train, feats, models.logistic(0.0, 0.0, 50), scaler="standard"), train, test, feats, "pipeline_std_logistic")


def m4_folds(s, d):
    """The same pipeline in cross-validation: every fold refits the scaler on its own training rows."""
    from riskframe.operators import models
    from riskframe.operators.search import kfold_auc
    m, train, test, feats = _split_model(s, d)
    aucs = kfold_auc(resample.kfold(train, "loan_id", 3), feats, lambda: models.logistic(0.0, 0.0, 50), 3, scaler="standard")
    return s.createDataFrame([(i, float(a)) for i, a in enumerate(aucs)], "fold int, auc double")


def m5(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return _eval(models.fit(train, feats, models.logistic(0.0, 0.0, 100)), train, test, feats, "logistic")


def m6(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    n = train.count()
    out = None
    _, legal = models.safe_features(train, feats)
    penalties = ("none", "l1", "l2", "elasticnet")
    # an iteration is a short job: the fits fill each other's gaps
    fits = _together([lambda p=models.sklearn_penalty(pen, 1.0, n): models.fit(train, feats, models.logistic(p["reg"], p["elastic"], 100))
                      for pen in penalties])
    for pen, mod in zip(penalties, fits, strict=True):
        t = models.coefficients(mod, legal).withColumn("penalty", F.lit(pen))
        out = t if out is None else out.unionByName(t)
    return out


def m7(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return _eval(models.fit(train, feats, models.linear_svc(0.0, 100)), train, test, feats, "linear_svc")


def m7_losses(s, d):
    """Squared hinge with L2 and with L1: scores on both splits and what the optimality conditions leave."""
    from riskframe.operators import svm
    m, train, test, feats = _split_model(s, d)
    out = None
    for penalty in ("l2", "l1"):
        fit = svm.squared_hinge(train, feats, C=1.0, penalty=penalty)
        one = _eval(fit.model, train, test, feats, f"squared_hinge_{penalty}").withColumns({
            "steps": F.lit(len(fit.objective) - 1), "zeros": F.lit(int((fit.model.coefficients == 0).sum())), "optimal": F.lit(bool(fit.violation < 1e-6))})
        out = one if out is None else out.unionByName(one)
    return out


def m8(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return _eval(models.fit(train, feats, models.decision_tree(5, 16)), train, test, feats, "decision_tree")


def m9(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return _eval(models.fit(train, feats, models.random_forest(10, 5)), train, test, feats, "random_forest")


def m10(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return _eval(models.fit(train, feats, models.gbt(10, 5)), train, test, feats, "gbt")


XGB_PARAMS = {"n_estimators": 20, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.8,
              "colsample_bytree": 0.8, "colsample_bylevel": 0.5, "min_child_weight": 1, "gamma": 0.0, "scale_pos_weight": 3.0,
              "reg_alpha": 0.1, "reg_lambda": 1.0}
LGB_PARAMS = {"n_estimators": 20, "num_leaves": 15, "max_depth": 6, "learning_rate": 0.1, "bagging_fraction": 0.8,
              "feature_fraction": 0.8, "min_sum_hessian_in_leaf": 1, "boosting_type": "gbdt", "reg_alpha": 0.1, "reg_lambda": 0.5}
CAT_PARAMS = {"iterations": 30, "depth": 4, "learning_rate": 0.1, "min_data_in_leaf": 5,
              "scale_pos_weight": 3.0, "l2_leaf_reg": 3.0, "one_hot_max_size": 2}
LEVEL_COLS = ["term", "grade", "home_ownership"]


def _boost(s, d, style, params):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    model, rows = models.fit_boosting(train, feats, style, params)
    return _eval(model, train, test, feats, style), rows


def _levels_split(s, d):
    """Train and test rows with their level columns encoded in CatBoost's way, and the features."""
    from riskframe.operators import boosting
    sp = _hold(resample.train_test_split(fx.loans_levels(s, d), "loan_id"))
    train, test = (sp.filter(F.col("split") == x).drop("split") for x in ("train", "test"))
    return boosting.encode_levels(train, test, "loan_id", LEVEL_COLS, CAT_PARAMS["one_hot_max_size"])


def boosting_params(s, d):
    """Every parameter of the three styles, the booster's own name for it and whether it is applied."""
    from riskframe.operators import models
    rows = [r for style, params in (("xgboost", XGB_PARAMS), ("lightgbm", LGB_PARAMS | {"drop_rate": 0.1, "skip_drop": 0.5, "top_rate": 0.2, "other_rate": 0.1}),
                                    ("catboost", CAT_PARAMS)) for r in models.map_boosting(style, params)[1]]
    # a round of each style on the loans, so the table speaks of fits that run
    m, train, test, feats = _split_model(s, d)
    fitted = {style: len(models.fit_boosting(train, feats, style, {k: v for k, v in params.items() if k not in ("n_estimators", "iterations")}
                                             | {("iterations" if style == "catboost" else "n_estimators"): 1})[0].roots)
              for style, params in (("xgboost", XGB_PARAMS), ("lightgbm", LGB_PARAMS), ("catboost", CAT_PARAMS))}
    return s.createDataFrame([(*r[:4], bool(r[4]) and fitted[r[0]] == 1) for r in rows],
                             "style string, param string, value string, spark_param string, applied boolean")


def m11(s, d):
    return _boost(s, d, "xgboost", XGB_PARAMS)[0]


def m12(s, d):
    return _boost(s, d, "lightgbm", LGB_PARAMS)[0]


def m12_ways(s, d):
    """The leaf-wise booster with every ``boosting_type``."""
    out = None
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    for way in ("gbdt", "dart", "goss"):
        model, _ = models.fit_boosting(train, feats, "lightgbm", LGB_PARAMS | {"boosting_type": way, "n_estimators": 10})
        one = _eval(model, train, test, feats, way)
        out = one if out is None else out.unionByName(one)
    return out


def m13(s, d):
    """Symmetric trees over ordered target statistics; a tenth of the training rows ends the rounds by AUC."""
    from riskframe.functions.rand import b as draw
    from riskframe.operators import models
    train, test, names = _levels_split(s, d)
    feats = [c for c in train.columns if c not in ("loan_id", "label")]
    held = train.withColumn("_fold", F.when(draw("val", F.col("loan_id")) % 10 == 0, F.lit(0)).otherwise(F.lit(-1)))
    model, _ = models.fit_boosting(held, feats, "catboost", CAT_PARAMS, fold_col="_fold", patience=10)
    return _eval(model, train, test, feats, "catboost")


HIST = {"max_depth": 3, "min_child_weight": 5.0, "reg_alpha": 2.0, "reg_lambda": 1.5, "scale_pos_weight": 3.0, "max_bins": 32}


def _first_cells(s, d):
    """The first pass of a fit on the loans' training rows: the root's sums by feature and bin."""
    from riskframe.operators import boosting
    m, train, test, feats = _split_model(s, d)
    p = boosting.Params(rounds=1, **HIST)
    cuts = boosting.collected_cuts(train, feats, p.max_bins)
    rows, path = boosting.binned_table(train, "loan_id", feats, cuts)
    tree = boosting.Tree()
    tree.add(0, (0.0, 0.0, 0))
    hist = boosting.histogram(rows, p, boosting.Round(0, [None], None), [(0, tree, 0)], np.ones((1, len(feats)), dtype=bool), max(map(len, cuts)))
    hist = cut_lineage(hist)
    from riskframe.session import delete_path
    delete_path(s, path)
    return hist, p, F.array(*[F.lit(f) for f in feats])


def m11_cuts(s, d):
    from riskframe.operators import boosting
    m, train, test, feats = _split_model(s, d)
    return boosting.bin_cuts(train, feats, HIST["max_bins"])


def m11_histogram(s, d):
    from riskframe.operators import boosting
    hist, _, names = _first_cells(s, d)
    unit = F.lit(float(boosting.UNIT))
    return hist.select(F.get(names, F.col("feature")).alias("feature"), "bin", (F.col("g").cast("double") / unit).alias("g"),
                       (F.col("h").cast("double") / unit).alias("h"), "n")


def m11_gains(s, d):
    """Gain of every admissible first cut."""
    from riskframe.operators import boosting
    hist, p, names = _first_cells(s, d)
    cuts = boosting.with_gain(boosting.sides(hist), p).filter("gain is not null")
    return cuts.select(F.get(names, F.col("feature")).alias("feature"), "bin", "gl", "hl", "nl", "gain")


def m13_levels(s, d):
    from riskframe.operators import boosting
    sp = resample.train_test_split(fx.loans_levels(s, d), "loan_id")
    return boosting.ordered_statistics(sp.filter(F.col("split") == "train"), "loan_id", LEVEL_COLS)


FOREST = {"trees": 100, "max_depth": 30, "min_leaf": 5}


def _bagged(s, d):
    from riskframe.operators import bagged
    m, train, test, feats = _split_model(s, d)
    fitted = bagged.forest(train, "loan_id", feats, bagged.Growth(**FOREST))
    if getattr(_CALL, "held", None) is not None:
        _CALL.held.append(fitted[0])  # the written subtrees are let go of with the query's tables
    return fitted, train, test, feats


def m15(s, d):
    """Forest of 100 trees with its out-of-bag score beside train and test."""
    (model, oob, _), train, test, feats = _bagged(s, d)
    own = s.createDataFrame([("forest_100", "oob", oob["accuracy"], oob["auc"])], "model string, split string, accuracy double, auc double")
    return _eval(model, train, test, feats, "forest_100").select("model", "split", "accuracy", "auc").unionByName(own)


def m15_importance(s, d):
    (_, _, imp), _, _, feats = _bagged(s, d)
    return s.createDataFrame([(f, float(v)) for f, v in zip(feats, imp)], "feature string, importance double")


def m16(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return _eval(models.fit(train, feats, models.naive_bayes(), scaler="minmax"), train, test, feats,
                 "naive_bayes")


def m17(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    mod = models.fit(train, feats, models.random_forest(20, 5))
    return models.importances(mod, models.safe_features(train, feats)[1])


def m18(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    mod = models.fit(train, feats, models.logistic(0.0, 0.0, 100))
    return models.coefficients(mod, models.safe_features(train, feats)[1])


def m19(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    return models.train_job(train, test, feats, penalty="l2", C=1.0, max_iter=100, tol=1e-4,
                            out_dir=_scratch(s, "m19"))


def s6(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    mod = models.fit(train, feats, models.logistic(0.0, 0.0, 50))
    path = _scratch(s, "model")
    models.save(mod, path)
    return _eval(models.load(path), train, test, feats, "loaded")


def s2(s, d):
    m = fx.loans_model(s, d)
    path = _scratch(s, "eda")
    tables.write_csv(m, path)
    return tables.read_csv(s, path, schema=m.schema)


def s5(s, d):
    m = tables.persist(fx.loans_model(s, d))
    out = profile.shape(m)
    return out


# ---------------------------------------------------------------- H: search
GBT_SPACE = {"maxDepth": ("randint", 2, 6), "stepSize": ("loguniform_q", 0.01, 0.5, 0.001),
             "maxIter": ("randint", 5, 20)}


def _val_split(s, d):
    """(train without validation, validation, test, features, train): validation is 20 % of the training split (md5)."""
    from riskframe.functions.rand import b as draw
    # every fit of a search passes over the rows several times: the draw is a column of the held table
    m, train, test, feats = _split_model(s, d, lambda t: t.withColumn("_val", draw("val", F.col("loan_id")) % 5 == 0))
    own = train.drop("_val")
    return train.filter(~F.col("_val")).drop("_val"), train.filter("_val").drop("_val"), test.drop("_val"), feats, own


def _gbt_from(p):
    from riskframe.operators import models
    return models.gbt(int(p["maxIter"]), int(p["maxDepth"]), float(p["stepSize"]))


def _holdout_objective(tr, va, feats):
    from riskframe.operators import models
    from riskframe.operators.search import holdout_metrics

    def obj(p):
        m = models.fit(tr, feats, _gbt_from(p), scaler=None)
        return 1.0 - holdout_metrics(models.score(m, va, feats))["auroc"]
    return obj


TRIAL_SCHEMA = ("iteration int, round int, maxDepth int, stepSize double, maxIter int, loss double, "
                "start_s double, end_s double, train_time double")


def _trials_df(s, trials):
    cols = [c.split()[0] for c in TRIAL_SCHEMA.split(", ")]
    return s.createDataFrame([tuple(t[c] for c in cols) for t in trials], TRIAL_SCHEMA)


def _search(s, d, rounds=5, per_round=4, split=None):
    from riskframe.operators.search import run_search
    tr, va, test, feats, train = split or _val_split(s, d)
    return run_search(_holdout_objective(tr, va, feats), GBT_SPACE, rounds, per_round, seed=42)


LR_GRID = {"regParam": [0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.5, 1.0], "maxIter": [500, 1000]}


def _lr_search(s, d):
    from riskframe.operators import models
    from riskframe.operators.search import cross_validate
    m, train, test, feats = _split_model(s, d)
    folds = resample.kfold(train, "loan_id", 5)
    best, table = cross_validate(folds, feats, models.logistic(), LR_GRID, folds=5)
    return best, table, train, test, feats


def h1(s, d):
    best, _, train, test, feats = _lr_search(s, d)
    return _eval(best, train, test, feats, "cv_best_logistic")


def h2(s, d):
    return _lr_search(s, d)[1]


# The grid's tree counts are a tenth of the search's own (100 to 500): see README for the measured time.
FOREST_GRID = {"criterion": ["gini", "entropy"], "trees": [10, 20, 30, 50], "max_depth": [20, 40, 60, 80, 100, 0], "min_leaf": [3, 4, 5],
               "min_split": [2, 5, 10]}


def h3(s, d):
    """All 432 combinations of the forest grid over three folds."""
    from riskframe.operators import bagged
    m, train, test, feats = _split_model(s, d)
    folds = resample.kfold(train, "loan_id", 3)
    return bagged.grid_accuracy(folds, "loan_id", feats, "fold", 3, FOREST_GRID)


def h5(s, d):
    return _trials_df(s, _search(s, d))


def h6(s, d):
    from riskframe.operators.search import kfold_auc
    # the fold is a column of the held table: raising the minority and scoring pass over it several times a fold
    m, folds, test, feats = _split_model(s, d, lambda t: resample.kfold(t, "loan_id", 3))
    # the minority is raised inside each fold's training rows, so no copy of a row crosses folds
    aucs = kfold_auc(folds, feats, lambda: _gbt_from({"maxIter": 10, "maxDepth": 3, "stepSize": 0.1}), 3,
                     rebalance=lambda tr: resample.upsample(tr, "loan_id").drop("draw"))
    rows = [(i, float(a)) for i, a in enumerate(aucs)] + [(-1, float(1.0 - np.mean(aucs)))]
    return s.createDataFrame(rows, "fold int, value double").withColumn(
        "stat", F.when(F.col("fold") < 0, F.lit("loss")).otherwise(F.lit("auc")))


def h7(s, d):
    from riskframe.operators import models
    from riskframe.operators.search import holdout_metrics
    tr, va, test, feats, train = _val_split(s, d)
    m = models.fit(tr, feats, _gbt_from({"maxIter": 10, "maxDepth": 3, "stepSize": 0.1}), scaler=None)
    r = holdout_metrics(models.score(m, va, feats))
    return s.createDataFrame([tuple(float(r[k]) for k in sorted(r))], ", ".join(f"{k} double" for k in sorted(r)))


def h8(s, d, patience: int = 10):
    """Cross-validated AUC after every boosting round; the search ends ``patience`` rounds after the best.

    The folds' models grow together, and a round is added to them in place."""
    from riskframe.operators import boosting
    m, train, test, feats = _split_model(s, d)
    folds = resample.kfold(train, "loan_id", 3)
    fitted = boosting.fit(folds, "loan_id", feats, boosting.Params(rounds=100, max_depth=3), fold_col="fold", models=3, patience=patience)
    return s.createDataFrame(fitted.history, "iteration int, mean_auc double, best boolean, stopped boolean")


def h9(s, d):
    from riskframe.operators.search import run_search
    from riskframe.sources import trial_logs
    tr, va, test, feats, train = _val_split(s, d)
    obj = _holdout_objective(tr, va, feats)
    path = _scratch(s, "study")
    first = run_search(obj, GBT_SPACE, 2, 5, seed=7)
    trial_logs.append(_trials_df(s, first), path)
    log = trial_logs.read_log(s, path, TRIAL_SCHEMA)
    start = log.agg(F.max("iteration")).first()[0] + 1
    # the log comes in as a table: its best trials as rows, all others as grouped counts
    more = run_search(obj, GBT_SPACE, 2, 5, seed=8, start_iteration=start, history=log)
    return _trials_df(s, more)


def _best_params(trials):
    best = min((t for t in trials if t["loss"] is not None), key=lambda t: (t["loss"], t["iteration"]))
    return {k: best[k] for k in GBT_SPACE}


def h10(s, d):
    from riskframe.operators import models
    tr, va, test, feats, train = split = _val_split(s, d)  # built once, for the search and the refit
    trials = _search(s, d, split=split)
    model = models.fit(train, feats, _gbt_from(_best_params(trials)), scaler=None)
    return _eval(model, train, test, feats, "refit_best")


def h11(s, d):
    from riskframe.operators import models
    tr, va, test, feats, train = split = _val_split(s, d)  # built once, for the search and the refits
    trials = _search(s, d, split=split)
    init, tuned = _together([lambda e=e: models.fit(train, feats, e, scaler=None) for e in (models.gbt(), _gbt_from(_best_params(trials)))])
    a = models.scored_splits(init, train, test, feats, "initial")
    b_ = models.scored_splits(tuned, train, test, feats, "tuned")
    return ev.evaluation_matrix(a.unionByName(b_), ["model", "split"]).filter(F.col("split") == "test")


def h12(s, d):
    t = _trials_df(s, _search(s, d, rounds=2, per_round=4))
    return t.select("iteration", F.timestamp_seconds(F.col("start_s")).alias("start"),
                    F.timestamp_seconds(F.col("end_s")).alias("end"), F.col("train_time").alias("seconds"))


# ---------------------------------------------------------------- F/X: model-based selection, explanations
F5_REG = 0.005  # lighter than the default 0.05, which leaves no group in on these loans
GROUPS = {"term": ["term_ 60 months"], "grade": ["grade_B", "grade_C", "grade_D", "grade_E"],
          "home_ownership": ["home_ownership_NONE", "home_ownership_OTHER", "home_ownership_OWN",
                             "home_ownership_RENT"]}


def _groups(feats):
    g = dict(GROUPS)
    taken = {c for cols in g.values() for c in cols}
    for f in feats:
        if f not in taken:
            g[f] = [f]
    return g


def f1(s, d):
    from riskframe.operators import explain
    m = _hold(_dealt(s, d, fx.loans_model(s, d)))
    return explain.gbt_importance(m, model_features(m))


def f2(s, d):
    from riskframe.operators import explain
    m = _dealt(s, d, fx.loans_model(s, d))  # persisted there
    return explain.importance_sweep(m, model_features(m))


def _perm(s, d, metric="accuracy"):
    from riskframe.operators import explain, models
    m, train, test, feats = _split_model(s, d)
    mod = models.fit(train, feats, models.gbt(10, 3), scaler=None)
    return explain.permutation_importance(mod, test, "loan_id", feats, repeats=3, metric=metric)


def f3(s, d):
    return _perm(s, d)


def x1(s, d):
    return _perm(s, d, metric="auc")


def _shap(s, d):
    from riskframe.operators import explain, models
    m, train, test, feats = _split_model(s, d)
    mod = models.fit(train, feats, models.gbt(10, 3), scaler=None)
    return explain.tree_shapley(mod, test, "loan_id", feats)


def f4(s, d):
    return _shap(s, d)[1]


def x4(s, d):
    return _shap(s, d)[0]


def f5(s, d):
    from riskframe.operators import explain
    m = fx.loans_model(s, d)
    feats = model_features(m)
    gt, curve, acc, _, converged = explain.group_lasso(m, feats, _groups(feats), group_reg=F5_REG, max_iter=3000, tol=1e-5)
    return gt.withColumn("train_accuracy", F.lit(acc)).withColumn("converged", F.lit(bool(converged)))


def f5_curve(s, d):
    from riskframe.operators import explain
    m = fx.loans_model(s, d)
    feats = model_features(m)
    return explain.group_lasso(m, feats, _groups(feats), group_reg=F5_REG, max_iter=3000, tol=1e-5)[1]


def f6(s, d):
    from riskframe.operators import explain
    m = fx.loans_model(s, d)
    feats = model_features(m)
    return explain.group_lasso_grid(m, feats, _groups(feats), [1e-1, 1e-2, 1e-3, 1e-4, 1e-5, 1e-6], folds=5, group_reg=F5_REG)


def _boruta(s, d):
    from riskframe.operators import explain
    m = fx.loans_model(s, d)
    return explain.boruta(m, "loan_id", model_features(m), max_rounds=100, trees=20)


def f11(s, d):
    return _boruta(s, d)[0]


def _history(s, d):
    """Rounds of twelve features with md5 importances: a feature's chance of a hit grows with its number."""
    from riskframe.functions.rand import b as draw
    c = tables.table(s, d, "customer").select("c_custkey")
    f = F.col("c_custkey") % 12
    x = draw("hist", F.col("c_custkey")) % 1000
    return c.select((F.floor(F.col("c_custkey") / 12)).cast("int").alias("round"), F.concat(F.lit("f"), f.cast("string")).alias("feature"),
                    (x.cast("double") / 1000 + f / 24.0).alias("importance"), F.lit(0.75).alias("max_shadow"),
                    (x.cast("double") / 1000 + f / 24.0 > 0.75).alias("hit"))


def f11_decisions(s, d):
    from riskframe.operators import explain
    return explain.binomial_decisions(_history(s, d))


def f12_decisions(s, d):
    from riskframe.operators import explain
    h = _history(s, d)
    return explain.tentative_fix(explain.binomial_decisions(h).drop("rounds"), h)


LINEAR = {"int_rate": 0.04, "term_ 60 months": 0.1, "grade_E": 0.15, "n_items": -0.01}


def _linear(df):
    """A fixed linear score, so that SQL can follow an explanation step by step."""
    return sum((q(c).cast("double") * F.lit(w) for c, w in LINEAR.items()), F.lit(0.0))


def f3_linear(s, d):
    from riskframe.operators import explain
    m, train, test, feats = _split_model(s, d)
    return explain.permutation_importance(_linear, test, "loan_id", list(LINEAR), repeats=3)


def x4_linear(s, d):
    from riskframe.operators import explain
    m, train, test, feats = _split_model(s, d)
    return explain.shapley(_linear, train, test, "loan_id", list(LINEAR), permutations=4)[0]


def f4_linear(s, d):
    from riskframe.operators import explain
    m, train, test, feats = _split_model(s, d)
    return explain.shapley(_linear, train, test, "loan_id", list(LINEAR), permutations=4)[1]


def f12(s, d):
    from riskframe.operators import explain
    dec, hist = _boruta(s, d)
    return explain.tentative_fix(dec, hist)


def f15(s, d):
    from riskframe.operators import models
    m, train, test, feats = _split_model(s, d)
    sel = [r["feature"] for r in select.quantile_cutoff(_mv(s, d), "mv", 0.7).collect()]
    model = models.fit(train, sel, models.random_forest(100, 5), scaler=None)
    return _eval(model, train, test, sel, "forest_screened").select("model", "split", "accuracy", "auc")


def x2(s, d):
    from riskframe.operators import explain, models
    m, train, test, feats = _split_model(s, d)
    mod = models.fit(train, feats, models.logistic(0.0, 0.0, 100))
    return explain.linear_contributions(mod, train, test, "loan_id", feats)


def x3(s, d):
    from riskframe.operators import explain, models
    m, train, test, feats = _split_model(s, d)
    mod = models.fit(train, feats, models.gbt(10, 3), scaler=None)
    # every test row is explained (the top-5 weights per row are the report)
    return explain.lime(mod, train, test, "loan_id", feats, n_samples=5000, top=5)


def _anova(s, d):
    from pyspark.ml.regression import RandomForestRegressor
    from riskframe.operators import anova, flat_trees, models
    t = _done(s, d)
    m = models.fit(t.withColumnRenamed("value", "label"), TRIAL_PARAMS,
                   RandomForestRegressor(featuresCol="unscaledFeatures", labelCol="label", numTrees=30,
                                         maxDepth=5, seed=42), scaler=None)
    r = t.agg(*[f(q(c)).cast("double").alias(f"{n}{i}") for i, c in enumerate(TRIAL_PARAMS) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    k = range(len(TRIAL_PARAMS))
    return anova.variance_shares(flat_trees.flatten(m, s), [r[f"lo{i}"] for i in k], [r[f"hi{i}"] for i in k])


def t9(s, d):
    """Share of the variance of the metric that each parameter explains, scaled to one."""
    single, _ = _anova(s, d)
    rows = [(c, float(v / max(single.sum(), 1e-300))) for c, v in zip(TRIAL_PARAMS, single)]
    return s.createDataFrame(sorted(rows, key=lambda x: -x[1]), "param string, importance double")


def t9_pairs(s, d):
    """Shares of parameters alone and of pairs beyond their members."""
    single, pair = _anova(s, d)
    rows = [(c, None, float(v)) for c, v in zip(TRIAL_PARAMS, single)] + [(TRIAL_PARAMS[a], TRIAL_PARAMS[b], float(v)) for (a, b), v in pair.items()]
    return s.createDataFrame(rows, "param string, with_param string, share double")



# ---------------------------------------------------------------- T: trial analytics
def _done(s, d):
    return trials.completed(fx.trials_c(s, d))


def t1(s, d):
    return trials.parse_params(fx.trials_a(s, d), "params",
                               ["boosting_type", "learning_rate", "max_depth", "subsample"],
                               {"learning_rate": "double", "max_depth": "int", "subsample": "double"}
                               ).select("iteration", "loss", "boosting_type", "learning_rate", "max_depth",
                                        "subsample")


def t2(s, d):
    return trials.rank_trials(_done(s, d), "value", 2, ascending=False).select("iteration", "value")


def t3(s, d):
    t = t1(s, d)
    return t.withColumns({c: F.col(c).cast("double") for c in ("learning_rate", "max_depth", "subsample")})


def t4(s, d):
    return trials.history(_done(s, d), "value", maximize=True)


def t5(s, d):
    return trials.metric_ecdf(_done(s, d), "value")


def t6(s, d):
    return trials.parallel_coordinates(_done(s, d), TRIAL_PARAMS, "value")


def t7(s, d):
    return trials.slices(_done(s, d), TRIAL_PARAMS, "value")


def t8(s, d):
    return trials.contour(_done(s, d), "learning_rate", "max_depth", "value", bins=5)


def t9_spearman(s, d):
    """Rank correlation of every parameter with the metric."""
    t = _done(s, d).select("iteration", "value", *TRIAL_PARAMS)
    return corr.spearman(t, "iteration", ["value", *TRIAL_PARAMS]).filter("feature_a = 'value'").select(
        F.col("feature_b").alias("param"), "rho")


def t10(s, d):
    return profile.kde_all(_done(s, d), TRIAL_PARAMS, grid=64, name="param")


def t10_binned(s, d):
    return profile.kde_all(_done(s, d), TRIAL_PARAMS, grid=64, name="param", binned=True)


def t11(s, d):
    return trials.trends(_done(s, d), TRIAL_PARAMS)


def t12(s, d):
    return trials.categorical_counts(_done(s, d), "boosting_type", BOOSTING_CODES)


def t13(s, d):
    return trials.duration_stats(fx.trials_c(s, d))


def t14(s, d):
    return _done(s, d)


def s8(s, d):
    return trials.study_export(_done(s, d).select("iteration", "value", "learning_rate", "max_depth", "state"),
                               "f1_weighted", {"value": "f1_weighted"})


def h4(s, d):
    return fx.trial_params(s, d).drop("ts")


# ---------------------------------------------------------------- S: sources / sinks
def _scratch(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory (never a machine-local path)."""
    from riskframe.session import ensure_checkpoint_dir
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{name}-{uuid.uuid4().hex[:8]}"


def s1(s, d):
    raw = fx.loans_raw(s, d)
    path = _scratch(s, "csv")
    tables.write_csv(raw, path)
    return tables.read_csv(s, path, schema=raw.schema)


def s3(s, d):
    m = fx.loans_model(s, d)
    num = m.select(*[q(c).cast("double").alias(c) for c in m.columns])
    path, names = _scratch(s, "mat"), _scratch(s, "names")
    tables.write_matrix(num, path, names)
    return tables.read_matrix(s, path, names)


def s4(s, d):
    return tables.cast_columns(fx.loans_model(s, d).select("loan_id", "int_rate", "installment"),
                               ["int_rate", "installment"], "int")


def s7(s, d):
    from riskframe.sources import trial_logs
    t = fx.trials_a(s, d)
    path = _scratch(s, "trials")
    trial_logs.append(t, path)
    return trial_logs.read_log_a(s, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "P1": p1, "P2": p2, "P3": p3, "P4": p4, "P5": p5, "P6": p6, "P7": p7, "P8": p8, "P8_unmatched": p8_unmatched, "P9": p9,
    "P10": p10, "P11": p11, "P12": p12, "P13": p13, "P14": p14, "P15": p15, "P16": p16, "P17": p17,
    "P18": p18, "P19": p19, "P20": p20, "P21": p21, "P22": p22,
    "A1": a1, "A2": a2, "A3": a3, "A4": a4, "A5": a5, "A6": a6, "A7": a7, "A8": a8, "A9": a9,
    "A10": a10, "A11": a11, "A12": a12, "A13": a13, "A14": a14, "A14_diff": a14_diff, "A4_levels": a4_levels, "A10_full": a10_full,
    "C1": c1, "C2": c2, "C3": c3, "C4": c4, "C5": c5, "C6": c6, "C4_pairs": c4_pairs, "C6_products": c6_products, "A11_sample": a11_sample,
    "E1": e1, "E2": e2, "E3": e3, "E4": e4, "E5": e5, "E6": e6, "E7": e7, "E8": e8, "E9": e9,
    "E10": e10, "E10_models": e10_models, "E11": e11, "E12": e12, "E13": e13, "E13_tests": e13_tests,
    "F7": f7, "F8": f8, "F9": f9, "F10": f10, "F13": f13, "F14": f14,
    "R1": r1, "R2": r2, "R3": r3, "R4": r4, "R4_pivot": r4_pivot, "R4_pruning": r4_pruning, "R4_points": r4_points, "M14_pivot": m14_pivot, "R5": r5, "R6": r6, "M14": m14, "M14_grid": m14_grid,
    "T1": t1, "T2": t2, "T3": t3, "T4": t4, "T5": t5, "T6": t6, "T7": t7, "T8": t8, "T10": t10,
    "T11": t11, "T12": t12, "T13": t13, "T14": t14, "S8": s8, "H4": h4,
    "S1": s1, "S2": s2, "S3": s3, "S4": s4, "S5": s5, "S6": s6, "S7": s7,
    "M1": m1, "M2": m2, "M3": m3, "M4": m4, "M4_folds": m4_folds, "M5": m5, "M6": m6, "M7": m7, "M8": m8, "M9": m9, "M10": m10,
    "M11": m11, "M12": m12, "M13": m13, "boosting_params": boosting_params, "M15": m15, "F15": f15, "M11_cuts": m11_cuts,
    "M11_histogram": m11_histogram, "M11_gains": m11_gains, "M12_ways": m12_ways, "M13_levels": m13_levels, "M15_importance": m15_importance,
    "H1": h1, "H2": h2, "H3": h3, "H5": h5, "H6": h6, "H7": h7, "H8": h8, "H9": h9, "H10": h10,
    "H11": h11, "H12": h12, "F1": f1, "F2": f2, "F3": f3, "F4": f4, "F5": f5, "F5_curve": f5_curve, "F6": f6, "F11": f11,
    "F12": f12, "X1": x1, "X2": x2, "X3": x3, "X4": x4, "T9": t9, "T9_pairs": t9_pairs, "M7_losses": m7_losses, "F10_rates": f10_rates,
    "A7_binned": a7_binned, "T10_binned": t10_binned, "T9_spearman": t9_spearman, "F11_decisions": f11_decisions, "F12_decisions": f12_decisions, "F3_linear": f3_linear,
    "X4_linear": x4_linear, "F4_linear": f4_linear, "M16": m16, "M17": m17, "M18": m18, "M19": m19,
}


def rounded(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, _CALL.held = getattr(_CALL, "held", None), []  # a list of this call: queries may run in threads
        try:
            out = round_doubles(fn(spark, sf_dir))
            if _CALL.held:
                # the fits are done: write the result and let go of the tables they read
                out = cut_lineage(out)
            return out
        finally:
            for df in _CALL.held:
                df.unpersist()
            _CALL.held = before
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: rounded(v) for k, v in QUERIES.items()}
