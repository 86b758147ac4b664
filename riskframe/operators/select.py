"""Feature selection.

Model-free screening (F7-F10) runs on the long form of the table:
per (feature, value) class counts, then distributed running sums give
every ECDF at every distinct value in O(n log n) — the reference's
O(n²) loops become one sort-based plan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.plans.prefix import prefix_sums
from riskframe.session import cut_lineage
from riskframe.plans.reshape import exact_quantiles, to_long, with_scalar_totals


def class_ecdf(df: DataFrame, cols, classes: list, label: str = "label") -> DataFrame:
    """Per (feature, distinct value): counts, running counts and totals per class
    (``c{r}``, ``cum_c{r}``, ``n{r}`` for the r-th class)."""
    long = to_long(df, [label], cols)
    names = [f"c{r}" for r in range(len(classes))]
    cnt = long.groupBy("feature", "value").agg(
        *[F.count_if(F.col(label) == F.lit(k)).alias(c) for c, k in zip(names, classes)])
    return prefix_sums(cnt, ["feature"], ["value"], names, prefix="cum_",
                       totals={c: f"n{r}" for r, c in enumerate(names)})


def mv_sis(df: DataFrame, cols, label: str = "label", max_classes: int = 200) -> DataFrame:
    """F7 + F8: MV-SIS index and Kolmogorov statistic per feature, for up to ``max_classes`` classes.

    ``MV = Σ_r p_r · mean_i (F_r(x_i) - F(x_i))²`` with ECDFs using ``<=``;
    ``KF = max_x max_{r,s} |F_r(x) - F_s(x)|``. Rows without a label count in no class.
    """
    df = df.select(*[q(c) for c in dict.fromkeys([*cols, label])]).persist()  # the classes and the counts read it
    found = df.select(q(label)).filter(q(label).isNotNull()).distinct().limit(max_classes + 1).collect()
    if len(found) > max_classes:
        raise ValueError(f"{label} has more than {max_classes} values: a class label is needed")
    classes = sorted(r[0] for r in found)
    e = class_ecdf(df, cols, classes, label)
    k = range(len(classes))

    def total(cs):
        return reduce(lambda a, b: a + b, cs)

    n = total([F.col(f"n{r}") for r in k]).cast("double")
    f = total([F.col(f"cum_c{r}") for r in k]) / n
    # a class without a value of this feature has no ECDF and no weight
    own = [F.when(F.col(f"n{r}") > 0, F.col(f"cum_c{r}") / F.col(f"n{r}").cast("double")) for r in k]
    c = total([F.col(f"c{r}") for r in k]).cast("double")
    sizes = [F.col(f"n{r}") for r in k]
    spread = F.greatest(*own) - F.least(*own) if len(own) > 1 else F.lit(0.0)
    g = e.groupBy("feature", *sizes).agg(
        *[F.coalesce(F.sum(c * F.pow(own[r] - f, 2)), F.lit(0.0)).alias(f"_s{r}") for r in k], F.max(spread).alias("kf"))
    nn = total(sizes).cast("double")
    mv = total([(F.col(f"n{r}") / nn) * F.col(f"_s{r}") / nn for r in k])
    out = cut_lineage(g.select("feature", mv.alias("mv"), "kf"))  # one row per feature
    df.unpersist()
    return out


def quantile_cutoff(scores: DataFrame, score: str, prob: float = 0.7) -> DataFrame:
    """keep features whose score is strictly above the ``prob`` quantile
    (interpolated, R type 7), with their rank (1 = highest)."""
    scores = cut_lineage(scores)  # one row per feature: the quantile and the ranking read it
    qt = exact_quantiles(scores.select(F.col(score).alias("_v")), [], "_v", [prob])
    j = with_scalar_totals(scores, qt)
    kept = j.filter(F.col(score) > F.col("q0"))
    # as many rows as the table has features
    turn = Window.orderBy(F.col(score).desc(), "feature")
    return kept.select("feature", F.col(score).alias("score"), F.col("q0").alias("cutoff"),
                       F.row_number().over(turn).cast("bigint").alias("rank"))


def screening_evaluation(ranks: DataFrame, true_set, n_obs: int, cs=(1, 2, 3),
                         probs=(0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """minimum model size covering the true set (quantiles over replications)
    and the share of replications whose true set is inside ``c·floor(n/ln n)``."""
    ts = list(true_set)
    per = ranks.filter(F.col("variable").isin(ts)).groupBy("replication").agg(
        F.max("rank").alias("min_size"), F.count(F.lit(1)).alias("_k"))
    per = per.filter(F.col("_k") == len(ts))
    qs = exact_quantiles(per.select(F.col("min_size").cast("double").alias("v")), [], "v", list(probs))
    base = math.floor(n_obs / math.log(n_obs))
    rates = per.agg(*[F.avg((F.col("min_size") <= c * base).cast("double")).alias(f"p_c{c}") for c in cs])
    j = with_scalar_totals(qs, rates)
    names = [f"q{int(round(p * 100)):02d}" for p in probs]
    st = [F.struct(F.lit(nm).alias("stat"), F.col(f"q{i}").alias("value")) for i, nm in enumerate(names)]
    st += [F.struct(F.lit(f"p_all_c{c}").alias("stat"), F.col(f"p_c{c}").alias("value")) for c in cs]
    return j.select(F.explode(F.array(*st)).alias("s")).select("s.stat", "s.value")


def selection_rates(ranks: DataFrame, true_set, n_obs: int, cs=(1, 2, 3)) -> DataFrame:
    """for every true variable the share of replications that rank it within ``c·floor(n/ln n)``."""
    base = math.floor(n_obs / math.log(n_obs))
    own = ranks.filter(F.col("variable").isin(list(true_set))).groupBy("variable").agg(
        F.count(F.lit(1)).alias("replications"), *[F.avg((F.col("rank") <= c * base).cast("double")).alias(f"rate_c{c}") for c in cs])
    return own


def method_differences(selected: DataFrame) -> DataFrame:
    """for every ordered pair of methods, features chosen by A and not by B, with counts.

    ``selected`` is (method, feature). The pairs come from the small
    method list; each difference is a left-anti join on feature.
    """
    methods = sorted(r["method"] for r in selected.select("method").distinct().collect())
    parts = []
    for a in methods:
        for b in methods:
            if a == b:
                continue
            sa = selected.filter(F.col("method") == a).select("feature")
            sb = selected.filter(F.col("method") == b).select("feature")
            parts.append(sa.join(sb, "feature", "left_anti")
                         .select(F.lit(a).alias("method_a"), F.lit(b).alias("method_b"), "feature"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    cnt = out.groupBy("method_a", "method_b").agg(F.count(F.lit(1)).alias("n_diff"))
    return out.join(cnt, ["method_a", "method_b"])


def feature_set_union(df: DataFrame, selected, extra=(), label: str = "label") -> DataFrame:
    """selected features + extra columns + label, then distinct rows."""
    cols = list(dict.fromkeys([*selected, *[c for c in extra if c in df.columns]]))
    missing = [c for c in extra if c not in df.columns]
    if missing:
        raise ValueError(f"unknown extra columns: {missing}")
    return df.select(*[q(c) for c in cols], q(label)).dropDuplicates()
