"""Feature preparation and classifiers on Spark ML.

Models are ``pyspark.ml`` pipelines: the scaler is a pipeline stage so
that every fit (including each CV fold) refits it on its own training
rows. Tables derived from fitted models (coefficients, importances) are
small driver-side lists turned into DataFrames.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import ml_names


def safe_features(df: DataFrame, features) -> tuple[DataFrame, list[str]]:
    """Rename feature columns to names ML stages accept (no dots or spaces)."""
    legal = ml_names(list(features))
    m = {a: b for a, b in zip(features, legal) if a != b}
    return (df.withColumnsRenamed(m) if m else df), legal


def assembler(features, out: str = "unscaledFeatures") -> VectorAssembler:
    """M1: rows with a null or NaN feature are skipped."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip")


def minmax(inp: str = "unscaledFeatures", out: str = "scaledFeatures") -> MinMaxScaler:
    """M2: to [0, 1], fitted on the training rows only."""
    return MinMaxScaler(inputCol=inp, outputCol=out)


def standard(inp: str = "unscaledFeatures", out: str = "scaledFeatures") -> StandardScaler:
    """M3: divide by the standard deviation, no centering."""
    return StandardScaler(inputCol=inp, outputCol=out, withStd=True, withMean=False)


def logistic(reg: float = 0.0, elastic: float = 0.0, max_iter: int = 100, tol: float = 1e-6,
             features: str = "scaledFeatures", weight: str | None = None) -> LogisticRegression:
    """M5 / M6: binomial logistic regression (elastic net)."""
    lr = LogisticRegression(featuresCol=features, labelCol="label", regParam=reg, elasticNetParam=elastic,
                            maxIter=max_iter, tol=tol, family="binomial")
    if weight:
        lr.setWeightCol(weight)
    return lr


def sklearn_penalty(penalty: str, C: float, n: int, l1_ratio: float = 0.5) -> dict:
    """M6: map ``penalty in {none,l1,l2,elasticnet}`` and ``C`` to Spark's
    ``regParam = 1/(C·n)`` and ``elasticNetParam``."""
    if penalty in (None, "none"):
        return {"reg": 0.0, "elastic": 0.0}
    reg = 1.0 / (C * n)
    return {"reg": reg, "elastic": {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio}[penalty]}


def linear_svc(reg: float = 0.0, max_iter: int = 100, tol: float = 1e-6,
               features: str = "scaledFeatures") -> LinearSVC:
    """M7: hinge loss with L2; squared hinge and L1 are in ``operators.svm``."""
    return LinearSVC(featuresCol=features, labelCol="label", regParam=reg, maxIter=max_iter, tol=tol)


def decision_tree(depth: int = 5, bins: int = 16, impurity: str = "gini", seed: int = 42,
                  features: str = "scaledFeatures", min_rows: int = 1) -> DecisionTreeClassifier:
    """M8."""
    return DecisionTreeClassifier(featuresCol=features, labelCol="label", maxDepth=depth, maxBins=bins,
                                  impurity=impurity, seed=seed, minInstancesPerNode=min_rows)


def random_forest(trees: int = 10, depth: int = 5, seed: int = 42, features: str = "scaledFeatures",
                  impurity: str = "gini", min_rows: int = 1, subset: str = "auto",
                  subsample: float = 1.0) -> RandomForestClassifier:
    """M9 / M15."""
    return RandomForestClassifier(featuresCol=features, labelCol="label", numTrees=trees, maxDepth=depth,
                                  seed=seed, impurity=impurity, minInstancesPerNode=min_rows,
                                  featureSubsetStrategy=subset, subsamplingRate=subsample)


def gbt(iters: int = 10, depth: int = 5, step: float = 0.1, seed: int = 42, features: str = "scaledFeatures",
        subsample: float = 1.0, subset: str = "all", min_rows: int = 1, min_gain: float = 0.0,
        weight: str | None = None, validation: str | None = None) -> GBTClassifier:
    """Gradient-boosted trees (the boosting library parameters map onto these)."""
    g = GBTClassifier(featuresCol=features, labelCol="label", maxIter=iters, maxDepth=depth, stepSize=step,
                      seed=seed, subsamplingRate=subsample, featureSubsetStrategy=subset,
                      minInstancesPerNode=min_rows, minInfoGain=min_gain)
    if weight:
        g.setWeightCol(weight)
    if validation:
        g.setValidationIndicatorCol(validation)
    return g


def naive_bayes(features: str = "scaledFeatures") -> NaiveBayes:
    """Gaussian naive Bayes."""
    return NaiveBayes(featuresCol=features, labelCol="label", modelType="gaussian")


def pipeline(features, estimator, scaler: str | None = "minmax") -> Pipeline:
    """M4: assembler + scaler + estimator, fitted together."""
    stages = [assembler(features)]
    if scaler == "minmax":
        stages.append(minmax())
    elif scaler == "standard":
        stages.append(standard())
    else:
        estimator.setFeaturesCol("unscaledFeatures")
    stages.append(estimator)
    return Pipeline(stages=stages)


def fit(df: DataFrame, features, estimator, scaler: str | None = "minmax") -> PipelineModel:
    d, legal = safe_features(df, features)
    return pipeline(legal, estimator, scaler).fit(d)


def score(model: PipelineModel, df: DataFrame, features, keep=("loan_id", "label")) -> DataFrame:
    """Transform and keep key, label, P(label = 1) as ``score`` and the prediction."""
    from riskframe.operators import bagged, flat_trees
    if isinstance(model, flat_trees.Forest | flat_trees.Linear):
        return flat_trees.score_rows(model, df, features, keep)
    if isinstance(model, bagged.GrownForest):
        return model.score_rows(df, features, keep)
    d, _ = safe_features(df, features)
    out = model.transform(d)
    return out.select(*keep, vector_to_array("probability")[1].alias("score"),
                      F.col("prediction").cast("int").alias("prediction")) \
        if "probability" in out.columns else \
        out.select(*keep, vector_to_array("rawPrediction")[1].alias("score"),
                   F.col("prediction").cast("int").alias("prediction"))


def coefficients(model: PipelineModel, features) -> DataFrame:
    """Sorted coefficients of a linear model (plus the intercept)."""
    m = model.stages[-1]
    rows = [(f, float(c)) for f, c in zip(features, m.coefficients.toArray())]
    rows.append(("(intercept)", float(m.intercept)))
    rows.sort(key=lambda r: -abs(r[1]))
    spark = _spark_of(model)
    return spark.createDataFrame(rows, "feature string, coefficient double")


def importances(model: PipelineModel, features) -> DataFrame:
    """Feature importance of a tree model, sorted."""
    m = model.stages[-1]
    rows = sorted(((f, float(v)) for f, v in zip(features, m.featureImportances.toArray())),
                  key=lambda r: (-r[1], r[0]))
    return _spark_of(model).createDataFrame(rows, "feature string, importance double")


def _spark_of(model):
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def save(model: PipelineModel, path: str) -> None:
    """Pipeline directory (overwrite)."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    """S6."""
    return PipelineModel.load(path)


def scored_splits(model: PipelineModel, train: DataFrame, test: DataFrame, features,
                  name: str = "model") -> DataFrame:
    """Score train and test with one model: (model, split, loan_id, label, score, prediction)."""
    return (score(model, train, features).withColumn("split", F.lit("train"))
            .unionByName(score(model, test, features).withColumn("split", F.lit("test")))
            .withColumn("model", F.lit(name)))


def train_job(train: DataFrame, test: DataFrame, features, penalty: str = "l2", solver: str = "lbfgs",
              max_iter: int = 100, C: float = 1.0, tol: float = 1e-4, l1_ratio: float = 0.5,
              out_dir: str | None = None) -> DataFrame:
    """Parameters in -> fitted pipeline (saved when ``out_dir``) and a metrics table out.

    ``solver`` is recorded only: Spark picks L-BFGS or OWL-QN from the penalty.
    """
    from riskframe.operators import evaluate as ev
    n = train.count()
    pen = sklearn_penalty(penalty, C, n, l1_ratio)
    model = fit(train, features, logistic(pen["reg"], pen["elastic"], max_iter, tol), scaler="minmax")
    if out_dir:
        save(model, out_dir)
    sc = scored_splits(model, train, test, features, name=f"lr_{penalty}")
    m = ev.metric_pairs(sc, ["model"], "split")
    return m.withColumn("penalty", F.lit(penalty)).withColumn("C", F.lit(float(C))).withColumn(
        "solver", F.lit(solver)).withColumn("reg_param", F.lit(float(pen["reg"])))


# Parameter names of the boosting libraries and the booster's own.
BOOSTING_MAP = {
    "xgboost": {"n_estimators": "rounds", "max_depth": "max_depth", "learning_rate": "learning_rate", "subsample": "subsample",
                "colsample_bytree": "colsample_bytree", "colsample_bylevel": "colsample_bylevel", "min_child_weight": "min_child_weight",
                "gamma": "gamma", "scale_pos_weight": "scale_pos_weight", "reg_alpha": "reg_alpha", "reg_lambda": "reg_lambda"},
    "lightgbm": {"n_estimators": "rounds", "max_depth": "max_depth", "num_leaves": "num_leaves", "learning_rate": "learning_rate",
                 "subsample": "subsample", "bagging_fraction": "subsample", "colsample_bytree": "colsample_bytree",
                 "feature_fraction": "colsample_bytree", "min_sum_hessian_in_leaf": "min_child_weight", "min_data_in_leaf": "min_data_in_leaf",
                 "boosting_type": "boosting", "drop_rate": "drop_rate", "skip_drop": "skip_drop", "top_rate": "top_rate",
                 "other_rate": "other_rate", "reg_alpha": "reg_alpha", "reg_lambda": "reg_lambda", "scale_pos_weight": "scale_pos_weight"},
    "catboost": {"iterations": "rounds", "depth": "max_depth", "learning_rate": "learning_rate", "min_data_in_leaf": "min_data_in_leaf",
                 "scale_pos_weight": "scale_pos_weight", "l2_leaf_reg": "reg_lambda", "one_hot_max_size": "one_hot_max_size"},
}
# What sets the styles apart: how trees grow, and the defaults of parameters that are not named.
BOOSTING_STYLE = {"xgboost": {"grow": "depth"}, "lightgbm": {"grow": "leaf", "max_depth": 0, "min_child_weight": 1e-3, "reg_lambda": 0.0},
                  "catboost": {"grow": "symmetric", "min_child_weight": 0.0, "reg_lambda": 3.0}}
WHOLE = {"rounds", "max_depth", "num_leaves", "min_data_in_leaf", "one_hot_max_size"}


def map_boosting(style: str, params: dict) -> tuple[dict, list[tuple]]:
    """Library parameters -> the booster's, and a (style, param, value, own name, applied) table."""
    kw, rows = dict(BOOSTING_STYLE[style]), []
    for name, value in params.items():
        own = BOOSTING_MAP[style].get(name)
        if own:
            kw[own] = str(value) if own == "boosting" else int(value) if own in WHOLE else float(value)
        rows.append((style, name, str(value), own or "", own is not None))
    return kw, rows


def fit_boosting(train: DataFrame, features, style: str, params: dict, key: str = "loan_id", seed: int = 42, label: str = "label",
                 fold_col: str | None = None, patience: int | None = None):
    """Fit the booster in a library's style: (forest on the features' own values, parameter table).

    With ``fold_col`` rows of fold 0 are held out and rounds end ``patience`` after the best AUC on them.
    """
    from riskframe.operators import boosting
    kw, rows = map_boosting(style, params)
    kw.pop("one_hot_max_size", None)  # of the encoding before the fit (boosting.encode_levels)
    fitted = boosting.fit(train, key, features, boosting.Params(seed=seed, **kw), label, fold_col, 1, patience)
    return fitted.forests[0], rows
