"""Evaluation over scored rows.

Input: a DataFrame with ``label`` (0/1), ``prediction`` (0/1) and/or a
``score`` and any grouping columns (model, split, train set, ...). All
counts for all groups come from one aggregate; ranking metrics (AUC,
ROC/PR curves) go through distinct scores plus distributed running sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.plans.prefix import prefix_sums


def confusion(df: DataFrame, keys=(), label: str = "label", pred: str = "prediction", own=()) -> DataFrame:
    """TP, TN, FP, FN and total (and the caller's ``own`` aggregates) per group in one aggregate."""
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*keys).agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count(F.lit(1)).alias("total"), *own)


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def rates(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 with zero guards (0 when undefined)."""
    tp, tn, fp, fn, tot = (F.col(c) for c in ("tp", "tn", "fp", "fn", "total"))
    p = _div(tp, tp + fp)
    r = _div(tp, tp + fn)
    return cm.select("*", _div(tp + tn, tot).alias("accuracy"), p.alias("precision"),
                     r.alias("recall")).withColumn(
        "f1", F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def classification_report(cm: DataFrame, keys=()) -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and weighted averages."""
    tp, tn, fp, fn, tot = (F.col(c) for c in ("tp", "tn", "fp", "fn", "total"))
    p1, r1 = _div(tp, tp + fp), _div(tp, tp + fn)
    p0, r0 = _div(tn, tn + fn), _div(tn, tn + fp)

    def f1(p, r):
        return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))

    s1, s0 = (tp + fn).cast("double"), (tn + fp).cast("double")
    def row(name, p, r, f, sup):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), sup.alias("support"))

    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f1(p0, r0), s0),
        row("1", p1, r1, f1(p1, r1), s1),
        row("accuracy", none, none, _div(tp + tn, tot), tot.cast("double")),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1(p0, r0) + f1(p1, r1)) / 2, tot.cast("double")),
        row("weighted avg", _div(p0 * s0 + p1 * s1, tot), _div(r0 * s0 + r1 * s1, tot),
            _div(f1(p0, r0) * s0 + f1(p1, r1) * s1, tot), tot.cast("double")),
    )
    return cm.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def weighted_f1(cm: DataFrame, keys=()) -> DataFrame:
    """E5: support-weighted F1 over both classes."""
    rep = classification_report(cm, keys)
    return rep.filter(F.col("class") == "weighted avg").select(*keys, F.col("f1").alias("f1_weighted"))


def hard_label_auc(cm: DataFrame, keys=()) -> DataFrame:
    """AUC of 0/1 predictions = (TPR + TNR) / 2."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cm.select(*keys, ((_div(tp, tp + fn) + _div(tn, tn + fp)) / 2).alias("roc_weighted"))


def _score_counts(df: DataFrame, keys, label: str, score: str) -> DataFrame:
    y = F.col(label)
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg"))


def auc(df: DataFrame, keys=(), label: str = "label", score: str = "score") -> DataFrame:
    """Exact area under ROC with ties (Mann-Whitney), per group.

    ``AUC = Σ_s pos(s) · (neg(< s) + neg(s)/2) / (P · N)`` over distinct scores.
    """
    return auc_of_counts(_score_counts(df, list(keys), label, score), keys)


def auc_of_counts(sc: DataFrame, keys=(), also=()) -> DataFrame:
    """E4 from (keys, score, n_pos, n_neg), one row a distinct score; columns ``also`` are summed up beside it."""
    keys = list(keys)
    c = prefix_sums(sc, keys, ["score"], ["n_neg"], prefix="cum_")
    term = F.col("n_pos").cast("double") * (F.col("cum_n_neg") - F.col("n_neg") * F.lit(0.5))
    g = c.groupBy(*keys).agg(F.sum(term).alias("_num"), F.sum("n_pos").alias("n_pos"),
                             F.sum("n_neg").alias("n_neg"), *[F.sum(x).alias(x) for x in also])
    return g.select(*keys, *also, F.when((F.col("n_pos") == 0) | (F.col("n_neg") == 0), F.lit(None))
                    .otherwise(F.col("_num") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))).alias("auc"))


def curves(df: DataFrame, keys=(), label: str = "label", score: str = "score") -> DataFrame:
    """E7 + E8: one point per distinct threshold (descending): FPR, TPR (= recall), precision."""
    keys = list(keys)
    sc = _score_counts(df, keys, label, score)
    c = prefix_sums(sc, keys, ["score"], ["n_pos", "n_neg"], descending=True, prefix="cum_",
                    totals={"n_pos": "_P", "n_neg": "_N"})
    return c.select(*keys, F.col("score").alias("threshold"),
                    _div(F.col("cum_n_neg"), F.col("_N")).alias("fpr"),
                    _div(F.col("cum_n_pos"), F.col("_P")).alias("tpr"),
                    _div(F.col("cum_n_pos"), F.col("cum_n_pos") + F.col("cum_n_neg")).alias("precision"))


def roc_curve(df: DataFrame, keys=(), **kw) -> DataFrame:
    """E7."""
    return curves(df, keys, **kw).select(*keys, "threshold", "fpr", "tpr")


def pr_curve(df: DataFrame, keys=(), **kw) -> DataFrame:
    """E8."""
    return curves(df, keys, **kw).select(*keys, "threshold", F.col("tpr").alias("recall"), "precision")


def test_error(df: DataFrame, keys=(), **kw) -> DataFrame:
    """1 - AUROC."""
    return auc(df, keys, **kw).select(*keys, (F.lit(1.0) - F.col("auc")).alias("test_error"))


def evaluation_matrix(df: DataFrame, keys=("model", "split")) -> DataFrame:
    """Every (model, training set, test set) group scored together: counts,
    rates and AUC from one grouped confusion aggregate plus one AUC plan."""
    keys = list(keys)
    r = rates(confusion(df, keys))
    a = auc(df, keys)
    return r.join(a, keys, "left")


def matrix_in_one_pass(df: DataFrame, keys) -> DataFrame:
    """The columns of ``evaluation_matrix``; rows that are scored lazily are read once.

    Counts are kept by score and added up beside the terms of the AUC: more columns to sort,
    one scoring less."""
    keys, counts = list(keys), ["tp", "tn", "fp", "fn", "total"]
    y = F.col("label")
    by_score = confusion(df, [*keys, "score"], own=[F.count_if(y == 1).alias("n_pos"), F.count_if(y == 0).alias("n_neg")])
    r = rates(auc_of_counts(by_score, keys, also=counts))
    return r.select(*[c for c in r.columns if c != "auc"], "auc")


def sensitivity_specificity(cm: DataFrame, keys=()) -> DataFrame:
    """sensitivity = TP/(TP+FN), specificity = TN/(TN+FP) (textbook names)."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    return cm.select(*keys, _div(tp, tp + fn).alias("sensitivity"), _div(tn, tn + fp).alias("specificity"))


def metric_pairs(df: DataFrame, keys=("model",), split: str = "split") -> DataFrame:
    """Four metrics for each split side by side: (model, metric, train, test)."""
    keys = list(keys)
    r = rates(confusion(df, keys + [split]))
    long = r.select(*keys, split, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("v"))
        for m in ("accuracy", "precision", "recall", "f1")])).alias("s"))
    long = long.select(*keys, split, "s.metric", "s.v")
    return long.groupBy(*keys, "metric").agg(
        F.max(F.when(F.col(split) == "train", F.col("v"))).alias("train"),
        F.max(F.when(F.col(split) == "test", F.col("v"))).alias("test"))


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 10000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) * h / a


def _beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return (lo + hi) / 2


def accuracy_tests(right: int, n: int, nir: float, fp: int, fn: int, level: float = 0.95) -> tuple[float, float, float, float]:
    """Exact binomial interval of the accuracy, P(X >= right) under the no-information rate,
    and McNemar's test of fp against fn (continuity-corrected, 1 degree of freedom)."""
    tail = (1 - level) / 2
    low = _beta_quantile(tail, right, n - right + 1) if right else 0.0
    high = _beta_quantile(1 - tail, right + 1, n - right) if right < n else 1.0
    p_acc = beta_cdf(nir, right, n - right + 1) if right else 1.0
    stat = max(abs(fp - fn) - 1, 0) ** 2 / (fp + fn) if fp + fn else 0.0
    return low, high, p_acc, math.erfc(math.sqrt(stat / 2))


def confusion_statistics(cm: DataFrame, keys=()) -> DataFrame:
    """Accuracy with its exact interval and p-value, no-information rate, kappa, balanced
    accuracy, prevalence, PPV, NPV, detection rate and prevalence, McNemar (positive class = 1).

    The tests are a few numbers per group, computed on the grouped confusion table."""
    tp, tn, fp, fn, n = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn", "total"))
    acc = _div(tp + tn, n)
    prev = _div(tp + fn, n)
    pe = _div((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    kappa = F.when(pe == 1, F.lit(0.0)).otherwise((acc - pe) / (F.lit(1.0) - pe))
    sens, spec = _div(tp, tp + fn), _div(tn, tn + fp)
    nir = F.greatest(prev, F.lit(1.0) - prev)
    names = ("accuracy_low", "accuracy_high", "accuracy_p", "mcnemar_p")

    def tests(parts):
        for pdf in parts:
            got = [accuracy_tests(int(r.tp + r.tn), int(r.total), float(r.nir), int(r.fp), int(r.fn)) if r.total else (None,) * 4
                   for r in pdf.itertuples()]
            for i, name in enumerate(names):
                pdf[name] = [g[i] for g in got]
            yield pdf.drop(columns=["tp", "tn", "fp", "fn", "total"])

    out = cm.select(*keys, "tp", "tn", "fp", "fn", "total", acc.alias("accuracy"), nir.alias("nir"),
                    kappa.alias("kappa"), ((sens + spec) / 2).alias("balanced_accuracy"),
                    prev.alias("prevalence"), _div(tp, tp + fp).alias("ppv"),
                    _div(tn, tn + fn).alias("npv"), _div(tp, n).alias("detection_rate"),
                    _div(tp + fp, n).alias("detection_prevalence"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields if f.name not in ("tp", "tn", "fp", "fn", "total")]
    return out.mapInPandas(tests, ", ".join(kept + [f"{n} double" for n in names]))
