"""Model-based selection and explanations.

Shuffles are joins on ranks: a column is permuted by numbering the rows
in two md5 orders and joining one numbering onto the other, so every
(feature, repeat) copy of a table is built and scored in one Spark job
instead of one job per feature. Tree models are flattened to node arrays
(``flat_trees``): shuffled copies, the perturbations of LIME and exact
Shapley values are made and reduced in the task that holds the row. The
sampled Shapley values of any other score are rows (``explode``), scored
by one ``transform`` and reduced by grouped aggregates.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.functions.rand import b, b60
from riskframe.operators import evaluate as ev
from riskframe.operators import flat_trees, models, shadow_rounds
from riskframe.operators.flat_trees import Forest
from riskframe.plans.gram import block_ranges, block_sums, row_blocks
from riskframe.plans.prefix import rank_within
from riskframe.session import cut_lineage, shuffle_partitions
from riskframe.plans.reshape import with_scalar_totals


# ---------------------------------------------------------------- permutations by join
def permuted_copies(df: DataFrame, key: str, features, repeats: int = 3, salt: str = "perm",
                    feature_col: str = "perm_feature") -> DataFrame:
    """Every (feature, repeat) copy of ``df`` with that one feature's values permuted.

    A repeat has one random order of the rows; row ``i`` of the base order meets
    the row that is ``i``-th in it and takes one feature from there, a different
    one in each copy. The rows are numbered and joined once a repeat; the copies
    are made while scoring and are never written.
    """
    feats = list(features)
    numbered = rank_within(df.withColumn("_h0", b(salt + ":base", q(key))), [], ["_h0", key], out="_bi", base=0).drop("_h0")
    out = None
    for r in range(repeats):
        donors = rank_within(df.select(key, *[q(f) for f in feats]).withColumn("_hs", b(f"{salt}:{r}", q(key))), [], ["_hs", key],
                             out="_bi", base=0).select("_bi", *[q(f).cast("double").alias(f"_d{i}") for i, f in enumerate(feats)])
        j = numbered.join(donors, "_bi").withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(feats) - 1))))
        names = F.array(*[F.lit(f) for f in feats])
        copies = j.select(*[c for c in df.columns if c not in feats], F.get(names, F.col("_i")).alias(feature_col), F.lit(r).alias("repeat"),
                          *[F.when(F.col("_i") == i, F.col(f"_d{i}")).otherwise(q(f).cast("double")).alias(f) for i, f in enumerate(feats)])
        out = copies if out is None else out.unionByName(copies)
    return out


def _scored(model, df: DataFrame, features, keep) -> DataFrame:
    """``model`` is a fitted pipeline, or a function (df) -> Column that gives the score itself."""
    if callable(model):
        s = model(df)
        return df.select(*keep, s.alias("score"), (s > 0.5).cast("int").alias("prediction"))
    return models.score(model, df, features, keep=keep)


def _permuted_counts(forest: Forest, df: DataFrame, key: str, features, repeats: int, salt: str, by_score: bool) -> DataFrame:
    """(perm_feature, repeat, score, n_pos, n_neg) of every shuffled copy, and of the rows as they are (feature null).

    The copies of ``permuted_copies`` made and scored inside the task that holds the row: a
    batch meets its donors' values and leaves one row of counts a score.
    """
    feats, d = list(features), len(list(features))
    wide = rank_within(df.select(key, "label", *[q(f).cast("double").alias(f"_x{i}") for i, f in enumerate(feats)])
                       .withColumn("_h0", b(salt + ":base", q(key))), [], ["_h0", key], out="_bi", base=0).drop("_h0")
    for r in range(repeats):
        donors = rank_within(df.select(key, *[q(f).cast("double").alias(f"_d{r}_{i}") for i, f in enumerate(feats)])
                             .withColumn("_hs", b(f"{salt}:{r}", q(key))), [], ["_hs", key], out="_bi", base=0).drop("_hs", key)
        wide = wide.join(donors, "_bi")
    cols = [F.col(f"_x{i}") for i in range(d)] + [F.col(f"_d{r}_{i}") for r in range(repeats) for i in range(d)]
    counts = wide.select(F.col("label").cast("double"), *cols).mapInArrow(
        flat_trees.permuted_sums(forest, d, repeats, by_score), "i int, repeat int, score double, n_pos bigint, n_neg bigint")
    names = F.array(*[F.lit(f) for f in feats])
    return (counts.groupBy("i", "repeat", "score").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))
            .select(F.when(F.col("i") >= 0, F.get(names, F.col("i"))).alias("perm_feature"), "repeat", "score", "n_pos", "n_neg"))


def permutation_importance(model, df: DataFrame, key: str, features, repeats: int = 3,
                           metric: str = "accuracy") -> DataFrame:
    """Score drop when one feature is shuffled (mean and std over repeats),
    scored on the data in hand: tree models where the rows lie, any other model by one
    ``transform`` of all copies."""
    feats = list(features)
    own = df.select(key, "label", *[q(c) for c in feats])
    if flat_trees.is_tree_model(model) or isinstance(model, Forest):
        forest = model if isinstance(model, Forest) else flat_trees.flatten(model, df.sparkSession)
        counts = _permuted_counts(forest, own, key, feats, repeats, "perm", metric == "auc")
        if metric == "auc":
            every = ev.auc_of_counts(counts, ["perm_feature", "repeat"]).withColumnRenamed("auc", "_s")
        else:
            right = F.when(F.col("score") == 1, F.col("n_pos")).otherwise(F.col("n_neg"))
            every = counts.groupBy("perm_feature", "repeat").agg((F.sum(right) / F.sum(F.col("n_pos") + F.col("n_neg"))).alias("_s"))
        rows = every.collect()  # one row a copy
        base = next((r["_s"] for r in rows if r["perm_feature"] is None), None)
        per = df.sparkSession.createDataFrame([tuple(r) for r in rows if r["perm_feature"] is not None],
                                              "perm_feature string, repeat int, _s double")
    else:
        base_sc = _scored(model, own, feats, (key, "label"))
        sc = _scored(model, permuted_copies(own, key, feats, repeats), feats, (key, "label", "perm_feature", "repeat"))
        if metric == "auc":
            base = ev.auc(base_sc.withColumn("_g", F.lit(1)), ["_g"]).first()["auc"]
            per = ev.auc(sc, ["perm_feature", "repeat"]).withColumnRenamed("auc", "_s")
        else:
            base = base_sc.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
            per = sc.groupBy("perm_feature", "repeat").agg(
                F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("_s"))
    drop = per.withColumn("_d", F.lit(base) - F.col("_s"))
    return (drop.groupBy(F.col("perm_feature").alias("feature"))
            .agg(F.avg("_d").alias("weight"), F.stddev_pop("_d").alias("std"))
            .orderBy(F.col("weight").desc(), "feature"))


# ---------------------------------------------------------------- F1, F2
def gbt_importance(df: DataFrame, features, iters: int = 20, depth: int = 5) -> DataFrame:
    """boosted-tree importance fitted on all rows."""
    m = models.fit(df, features, models.gbt(iters, depth), scaler=None)
    return models.importances(m, list(features))


def importance_sweep(df: DataFrame, features, iters: int = 10, depth: int = 3, workers: int = 4) -> DataFrame:
    """for each distinct importance t (zero included): keep features with importance >= t,
    refit, training accuracy. Fits run concurrently. The choice keeps at least 2 and fewer than
    all features, and has the highest accuracy that is no lower than any smaller set's
    (fewest features on ties); none if no set qualifies."""
    feats = list(features)
    df = df.select("label", *[q(c) for c in feats]).persist()  # one fit per threshold reads it
    imp = {r["feature"]: r["importance"] for r in gbt_importance(df, feats, iters, depth).collect()}
    thresholds = sorted(set(imp.values()))

    def one(t):
        keep = [f for f in feats if imp[f] >= t]
        m = models.fit(df, keep, models.gbt(iters, depth), scaler=None)
        acc = models.score(m, df, keep, keep=("label",)).agg(
            F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        return (float(t), len(keep), float(acc))

    with ThreadPoolExecutor(max_workers=workers) as ex:
        rows = list(ex.map(one, thresholds))
    df.unpersist()
    fit_for = [r for r in rows if 2 <= r[1] < len(feats)]
    best = max(fit_for, key=lambda r: (r[2], -r[1])) if fit_for else None
    out = [(t, n, a, (t, n, a) == best) for t, n, a in rows]
    return df.sparkSession.createDataFrame(out, "threshold double, n_features int, accuracy double, best boolean")


# ---------------------------------------------------------------- F5, F6 group lasso
def _ranges(blocks: DataFrame, columns: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and width (1 where it is constant) of each of the first ``features`` of the blocks' columns."""
    lo, hi = (x[:features] for x in block_ranges(blocks, columns))
    return lo, np.where(hi > lo, hi - lo, 1.0)


def _penalty(beta: np.ndarray, groups, group_reg: float, l1_reg: float) -> float:
    return sum(group_reg * math.sqrt(len(i)) * float(np.linalg.norm(beta[i])) for i in groups) + l1_reg * float(np.abs(beta).sum())


def _prox(v: np.ndarray, t: float, groups, group_reg: float, l1_reg: float) -> np.ndarray:
    out = np.sign(v) * np.maximum(0, np.abs(v) - t * l1_reg)
    for idx in groups:
        norm, limit = np.linalg.norm(out[idx]), t * group_reg * math.sqrt(len(idx))
        out[idx] = 0.0 if norm <= limit else out[idx] * (1 - limit / norm)
    return out


def _model_minimum(g: np.ndarray, h: np.ndarray, at: np.ndarray, groups, group_reg: float, l1_reg: float) -> np.ndarray:
    """Minimum of the quadratic model at ``at`` plus the penalty (the last entry, the intercept, is free)."""
    step = 1.0 / max(float(np.linalg.eigvalsh(h).max()), 1e-12)
    x, y, t = at.copy(), at.copy(), 1.0
    for _ in range(20000):
        new = y - step * (g + h @ (y - at))
        new[:-1] = _prox(new[:-1], step, groups, group_reg, l1_reg)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        done = np.linalg.norm(new - x) <= 1e-12 * max(1.0, np.linalg.norm(x))
        x, t = new, t2
        if done:
            break
    return x


def lasso_path(df: DataFrame, features, groups: dict[str, list[str]], group_reg: float, l1_reg: float, max_iter: int, tol: float):
    """Proximal Newton steps from zero: [(coefficients on [0, 1] features and intercept, loss, change)].

    A step is one pass over the rows, for loss, gradient and curvature together;
    the penalised quadratic model is a problem of the features' size and is
    solved on the driver. A step that raises the loss is halved.
    """
    feats = list(features)
    data = row_blocks(df, [*feats, "label"]).persist()
    lo, width = _ranges(data, len(feats) + 1, len(feats))
    idx = [[feats.index(c) for c in cols] for cols in groups.values()]
    d = len(feats)

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(x: np.ndarray) -> np.ndarray:
            z = np.hstack([(x[:, :-1] - lo) / width, np.ones((len(x), 1))])
            lin, y = z @ w, x[:, -1]
            p = 1 / (1 + np.exp(-np.clip(lin, -500, 500)))
            loss = np.logaddexp(0, lin) - y * lin
            return np.concatenate([[len(x), loss.sum()], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])
        v = block_sums(data, d + 1, sums)
        n = max(v[0], 1.0)
        return v[1] / n + _penalty(w[:-1], idx, group_reg, l1_reg), v[2:d + 3] / n, v[d + 3:].reshape(d + 1, d + 1) / n

    w = np.zeros(d + 1)
    loss, g, h = look(w)
    path = [(w, loss, math.inf)]
    while len(path) <= max_iter:
        target = _model_minimum(g, h + 1e-10 * np.eye(d + 1), w, idx, group_reg, l1_reg)
        step = 1.0
        while True:
            new = w + step * (target - w)
            new_loss, new_g, new_h = look(new)
            if new_loss <= loss + 1e-12 or step < 1e-6:
                break
            step /= 2
        change = float(np.linalg.norm(new - w) / max(1.0, np.linalg.norm(w)))
        w, loss, g, h = new, new_loss, new_g, new_h
        path.append((w, loss, change))
        if change < tol:
            break
    data.unpersist()
    return path, (lo, width)


def group_lasso(df: DataFrame, features, groups: dict[str, list[str]], group_reg: float = 0.05,
                l1_reg: float = 0.0, max_iter: int = 3000, tol: float = 1e-5):
    """group-lasso logistic regression (group soft-threshold with ``sqrt(|g|)`` weights).

    Returns (groups table, loss curve, training accuracy, (coefficients, intercept, scaling), converged).
    """
    feats = list(features)
    path, scaling = lasso_path(df, feats, groups, group_reg, l1_reg, max_iter, tol)
    w = path[-1][0]
    acc = df.select(*[q(c) for c in feats], "label").dropna().agg(
        F.avg(((_margin(w, feats, scaling) > 0).cast("int") == F.col("label")).cast("double"))).first()[0]
    norms = {g: float(np.linalg.norm(w[[feats.index(c) for c in cols]])) for g, cols in groups.items()}
    spark = df.sparkSession
    gt = spark.createDataFrame([(g, len(groups[g]), n, n > 0) for g, n in norms.items()],
                               "group string, n_cols int, norm double, selected boolean")
    curve = spark.createDataFrame([(i, float(x[1])) for i, x in enumerate(path)], "iteration int, loss double")
    return gt, curve, float(acc), (w[:-1], float(w[-1]), scaling), path[-1][2] < tol


def _margin(w: np.ndarray, feats, scaling):
    """The linear score of a row as a column."""
    lo, width = scaling
    out = F.lit(float(w[-1]))
    for i, c in enumerate(feats):
        out = out + (q(c).cast("double") - F.lit(float(lo[i]))) / F.lit(float(width[i])) * F.lit(float(w[i]))
    return out


def group_lasso_grid(df: DataFrame, features, groups, tols, key: str = "loan_id", folds: int = 5,
                     group_reg: float = 0.05, l1_reg: float = 0.0, max_iter: int = 3000) -> DataFrame:
    """k-fold accuracy of the group lasso for each tolerance.

    One descent to the tightest tolerance per fold passes through the answer of
    every looser one: the point where the change first falls below it.
    """
    from riskframe.operators.resample import kfold
    feats = list(features)
    d = kfold(df.select(key, "label", *[q(c) for c in feats]), key, folds, salt="gl").persist()
    scores: dict[float, list[float]] = {t: [] for t in tols}
    for f in range(folds):
        path, scaling = lasso_path(d.filter(F.col("fold") != f), feats, groups, group_reg, l1_reg, max_iter, min(tols))
        at = {t: next((x[0] for x in path if x[2] < t), path[-1][0]) for t in tols}
        r = d.filter(F.col("fold") == f).agg(*[
            F.avg(((_margin(w, feats, scaling) > 0).cast("int") == F.col("label")).cast("double")).alias(f"a{i}")
            for i, w in enumerate(at.values())]).first()
        for i, t in enumerate(at):
            scores[t].append(r[f"a{i}"])
    d.unpersist()
    return df.sparkSession.createDataFrame([(float(t), float(np.mean(a)), folds) for t, a in scores.items()],
                                           "tol double, cv_accuracy double, folds int")


# ---------------------------------------------------------------- F11, F12 Boruta
def _binom_sf(k: int, n: int) -> float:
    """P(X >= k) for X ~ Binomial(n, 1/2).

    Whole numbers up to 1,000 rounds; beyond, the tail is summed from its largest term in
    doubles and left when a term no longer counts (some √n terms, whatever k is).
    """
    if n <= 1000:
        return sum(math.comb(n, i) for i in range(k, n + 1)) / 2 ** n
    if k <= 0:
        return 1.0
    if 2 * k <= n:
        return 1.0 - _binom_sf(n - k + 1, n)
    tail, term, i = 0.0, 1.0, k
    while i <= n and term > 1e-18 * tail:
        tail += term
        term *= (n - i) / (i + 1)
        i += 1
    return tail * math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) if k <= n else 0.0


def shadow_shifts(count: int, n: int, r: int) -> list[int]:
    """Offsets of round ``r``, one a feature, drawn from the n row numbers without repeats while they last."""
    drawn = random.Random(7919 * r + 1)
    return [x for lo in range(0, count, max(n, 1)) for x in drawn.sample(range(max(n, 1)), min(count - lo, max(n, 1)))]


def rounds_until_decided(hits: list[int], r: int, adj: float) -> int:
    """How many rounds after round ``r`` must be run with the same features: up to the first that may reject an
    undecided one (no more hits) or that may decide the last of them. ``hits`` are those of the undecided features."""
    def first(h: int, more: bool) -> int:
        k = 1
        while _binom_sf(h + k if more else r + k - h, r + k) >= adj:
            k += 1
        return k

    reject = [first(h, False) for h in hits]
    return min([*reject, max(min(a, first(h, True)) for a, h in zip(reject, hits, strict=True))])


def boruta(df: DataFrame, key: str, features, max_rounds: int = 100, trees: int = 30, depth: int = 5,
           alpha: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """rounds of forest importance against shuffled shadow copies.

    A hit is an importance above the best shadow of that round. After each
    round a two-sided binomial test (Bonferroni over all features) confirms or
    rejects; rejected features leave the race, and it ends when all are decided
    or after ``max_rounds``. Rounds that no decision can prevent or change grow in the same
    passes (``shadow_rounds``). Returns (decisions with importance statistics, history).
    """
    feats = list(features)
    spark = df.sparkSession
    rows = shadow_rounds.binned_rows(df, key, feats)  # binned and numbered once, read by every round
    n = int(rows.starts[-1])
    history, hits = [], dict.fromkeys(feats, 0)
    decided: dict[str, tuple[str, int]] = {}
    adj = alpha / len(feats)
    r = 0
    while r < max_rounds and len(decided) < len(feats):
        live = [f for f in feats if decided.get(f, ("", 0))[0] != "Rejected"]
        # these rounds are run whatever the first of them finds
        sure = min(rounds_until_decided([hits[f] for f in feats if f not in decided], r, adj), max_rounds - r)
        numbers = list(range(r, r + sure))
        found = shadow_rounds.round_importances(rows, [feats.index(f) for f in live], numbers,
                                                [shadow_shifts(len(live), n, number) for number in numbers], trees, depth)
        for imp in found:
            real, best_shadow = imp[:len(live)], float(imp[len(live):].max())
            r += 1
            for i, f in enumerate(live):
                hit = real[i] > best_shadow
                hits[f] += int(hit)
                history.append((r - 1, f, float(real[i]), best_shadow, bool(hit)))
                if f not in decided:
                    if _binom_sf(hits[f], r) < adj:
                        decided[f] = ("Confirmed", r)
                    elif _binom_sf(r - hits[f], r) < adj:
                        decided[f] = ("Rejected", r)
    shadow_rounds.let_go(rows)
    hist = spark.createDataFrame(history, "round int, feature string, importance double, max_shadow double, hit boolean")
    rows = [(f, hits[f], *decided.get(f, ("Tentative", r))) for f in feats]
    return importance_statistics(spark.createDataFrame(rows, "feature string, hits int, decision string, decided_in int"), hist), hist


def importance_statistics(decisions: DataFrame, history: DataFrame) -> DataFrame:
    """Mean, median, least and greatest importance and share of hits of every feature."""
    st = history.groupBy("feature").agg(
        F.avg("importance").alias("mean_imp"), F.median("importance").alias("median_imp"), F.min("importance").alias("min_imp"),
        F.max("importance").alias("max_imp"), F.avg(F.col("hit").cast("double")).alias("hit_share"),
        F.count(F.lit(1)).alias("rounds"))
    return decisions.join(st, "feature", "left")


def binomial_decisions(history: DataFrame, alpha: float = 0.05) -> DataFrame:
    """F11's test over a whole history: hits and decision of every feature."""
    per = history.groupBy("feature").agg(F.count(F.lit(1)).alias("rounds"), F.count_if("hit").alias("hits"))
    n_feats = history.select("feature").distinct().count()
    pairs = [tuple(r) for r in per.select("rounds", "hits").distinct().collect()]  # at most one a feature

    def decide(n: int, k: int) -> str:
        return ("Confirmed" if _binom_sf(k, n) < alpha / n_feats else
                "Rejected" if _binom_sf(n - k, n) < alpha / n_feats else "Tentative")

    found = history.sparkSession.createDataFrame([(n, k, decide(n, k)) for n, k in pairs], "rounds bigint, hits bigint, decision string")
    return per.join(found, ["rounds", "hits"], "left").select(*per.columns, "decision")


def tentative_fix(decisions: DataFrame, history: DataFrame) -> DataFrame:
    """tentative -> Confirmed if median importance > median of the best shadow."""
    med = history.groupBy("feature").agg(F.median("importance").alias("med_imp"),
                                         F.median("max_shadow").alias("med_shadow"))
    j = decisions.join(med, "feature")
    return j.withColumn("final", F.when(F.col("decision") != "Tentative", F.col("decision"))
                        .when(F.col("med_imp") > F.col("med_shadow"), F.lit("Confirmed"))
                        .otherwise(F.lit("Rejected")))


# ---------------------------------------------------------------- X2 linear contributions
def linear_contributions(model, train: DataFrame, rows: DataFrame, key: str, features) -> DataFrame:
    """Exact contributions of a (scaled) linear model: coef_j · (z_j - mean_j(z)),
    with z the pipeline's scaled features; ``base`` = the model margin at the mean."""
    from pyspark.ml.functions import vector_to_array
    feats = list(features)
    tr, legal = models.safe_features(train, feats)
    rw, _ = models.safe_features(rows, feats)
    prep = models.PipelineModel(stages=model.stages[:-1])
    coef = model.stages[-1].coefficients.toArray()
    zt = prep.transform(tr).select(vector_to_array("scaledFeatures").alias("z"))
    means = zt.agg(*[F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(len(feats))]).first()
    zr = prep.transform(rw).select(key, vector_to_array("scaledFeatures").alias("z"))
    st = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                      ((F.col("z")[i] - F.lit(float(means[f"m{i}"]))) * F.lit(float(coef[i])))
                                      .alias("contribution")) for i, f in enumerate(feats)]))
    return zr.select(key, st.alias("s")).select(key, "s.feature", "s.contribution")


# ---------------------------------------------------------------- X3 LIME
def lime(model, train: DataFrame, rows: DataFrame, key: str, features, n_samples: int = 5000,
         top: int = 5, alpha: float = 1.0, salt: int = 0) -> DataFrame:
    """Local surrogate per row, of a tree model or a logistic regression.

    ``n_samples`` perturbations ``x + sd·N(0,1)`` of a row are drawn from the row's own
    seed, scored by the flat model and reduced to the weights of a kernel-weighted ridge of
    P(label=1), all in the task that holds the row: no perturbation leaves it.
    Returns the ``top`` signed weights per row (a top-k report).
    """
    feats = list(features)
    forest = flat_trees.scorer(model, rows.sparkSession)
    sd = train.agg(*[F.stddev_samp(q(c)).alias(f"s{i}") for i, c in enumerate(feats)]).first()
    sds = np.array([float(sd[f"s{i}"] or 0.0) or 1.0 for i in range(len(feats))])
    kind = rows.schema[key].dataType.simpleString()
    own = rows.select(q(key), F.xxhash64(q(key)).alias("seed"), *[q(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)])
    # few bytes a row but much work: dealt by rows, not by bytes
    found = own.repartition(4 * shuffle_partitions(rows.sparkSession), "seed").mapInArrow(
        flat_trees.surrogate_weights(forest, sds, n_samples, top, alpha, 0.75 * math.sqrt(len(feats)), salt),
        f"key {kind}, i int, weight double, rank int")
    return found.select(F.col("key").alias(key), F.get(F.array(*[F.lit(f) for f in feats]), F.col("i")).alias("feature"), "weight", "rank")


# ---------------------------------------------------------------- X4 Shapley
def tree_shapley(model, rows: DataFrame, key: str, features, output: int = 0) -> tuple[DataFrame, DataFrame, float]:
    """Exact Shapley values of a tree model's output (margin of boosted trees, share of class ``output`` of others).

    A coalition's worth is the output with the absent features averaged by the training rows
    of each branch. Returns (phi per (row, feature), mean |phi| per feature, expected value);
    expected value + Σφ is the row's output.
    """
    feats = list(features)
    forest = model if isinstance(model, Forest) else flat_trees.flatten(model, rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()
    phi = rows.select(q(key), *[q(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)]).mapInArrow(
        flat_trees.shapley_rows(forest, len(feats), output), f"key {kind}, phi array<double>")
    long = phi.select(F.col("key").alias(key), F.posexplode("phi").alias("i", "phi")).select(
        key, F.get(F.array(*[F.lit(f) for f in feats]), F.col("i")).alias("feature"), "phi")
    return long, long.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")), flat_trees.expected_value(forest, output)


def shapley(model, background: DataFrame, rows: DataFrame, key: str, features, permutations: int = 10,
            salt: str = "shap") -> tuple[DataFrame, DataFrame]:
    """Permutation-sampling Shapley values.

    For row e and sample m: a feature order (md5 of e, m, feature) and a
    background row (md5 index into ``background``); steps k = 0..d switch
    the first k features of the order from background to e's values. All
    rows × samples × steps are scored by one ``transform``; the change
    at step k is credited to the k-th feature. Per sample the credits add
    up to f(x) - f(background), so Σφ = f(x) - mean f(background) exactly.
    Returns (phi per (row, feature), summary mean |phi| per feature).
    """
    feats = list(features)
    d = len(feats)
    bg = background.select(*[q(c).cast("double").alias(c) for c in feats], q(key).alias("_bk"))
    nbg = bg.count()
    bg = rank_within(bg.withColumn("_h", b(salt + "bg", F.col("_bk"))), [], ["_h", "_bk"], out="_bi",
                     base=0).select("_bi", *[F.col(c).alias("_bg_" + c) for c in feats])
    r = rows.select(key, *[q(c).cast("double").alias(c) for c in feats])
    em = r.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1))))
    ek = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("_m").cast("string"))
    em = em.withColumn("_bi", b60(salt + "pick", ek) % nbg).join(bg, "_bi")
    # position of each feature in the order of (row, sample): the features sorted by md5
    drawn = F.array(*[F.struct(b(F.concat(F.lit(salt + ":" + f + ":"), ek), F.lit("")).alias("h"), F.lit(i).alias("i"))
                      for i, f in enumerate(feats)])
    em = em.withColumn("_order", F.transform(F.array_sort(drawn), lambda x: x["i"]))
    em = em.withColumns({"_pos_" + f: (F.array_position("_order", i) - 1).cast("int") for i, f in enumerate(feats)}).drop("_order")
    steps = em.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(d))))
    steps = steps.withColumns({f: F.when(F.col("_pos_" + f) < F.col("_k"), q(f)).otherwise(F.col("_bg_" + f))
                               for f in feats})
    sc = _scored(model, steps.withColumn("label", F.lit(0)), feats, (key, "_m", "_k", *["_pos_" + f for f in feats]))
    w = Window.partitionBy(key, "_m").orderBy("_k")  # d + 1 rows per (row, sample)
    delta = sc.withColumn("_delta", F.col("score") - F.lag("score").over(w)).filter(F.col("_k") > 0)
    credit = delta.select(key, "_m", "_delta", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col("_pos_" + f) == F.col("_k") - 1).alias("hit"))
        for f in feats])).alias("s")).filter("s.hit")
    phi = credit.groupBy(key, F.col("s.feature").alias("feature")).agg(
        (F.sum("_delta") / F.lit(float(permutations))).alias("phi"))
    summary = phi.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
    return phi, summary
