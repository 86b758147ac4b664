"""Bagged forests against numpy: the same bags, the same cuts, the same out-of-bag votes."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.functions.rand import b60
from riskframe.operators import bagged as bg
from riskframe.operators import boosting as bo
from riskframe.operators import models

COLS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.integers(0, 9, 500), np.round(rng.normal(size=500), 1), rng.integers(0, 2, 500), rng.normal(size=500), rng.integers(0, 4, 500)])
    pdf = pd.DataFrame(x.astype(float), columns=COLS)
    pdf["label"] = ((x[:, 0] > 4) ^ (x[:, 2] > 0) ^ (rng.random(500) < 0.15)).astype(int)
    pdf["key"] = np.arange(500)
    pdf["fold"] = pdf["key"] % 3
    df = spark.createDataFrame(pdf).repartition(3).persist()
    draws = {r["key"]: r["row"] for r in df.select("key", b60("row", F.col("key")).alias("row")).collect()}
    return df, pdf, np.array([draws[k] for k in pdf["key"]])


def imp(n, p, criterion):
    if n == 0:
        return 0.0
    if criterion == "gini":
        return 2 * p * (n - p) / n
    return sum(-c * math.log(c / n) for c in (p, n - p) if c)


def tree_by_hand(bins, y, w, g, path, depth=0, rows=None):
    rows = np.flatnonzero(w) if rows is None else rows
    n, p = w[rows].sum(), (w[rows] * y[rows]).sum()
    node = (int(n), int(p))
    if n < max(g.min_split, 2 * g.min_leaf) or p in (0, n) or (g.max_depth and depth >= g.max_depth):
        if depth or p in (0, n):
            return node
    best = None
    for f in bg.drawn_features(path, bins.shape[1], g.subset, g.seed)[0]:
        for c in np.unique(bins[rows, f])[:-1]:
            left = rows[bins[rows, f] <= c]
            nl, pl = w[left].sum(), (w[left] * y[left]).sum()
            if min(nl, n - nl) < g.min_leaf:
                continue
            gain = round(imp(n, p, g.criterion) - imp(nl, pl, g.criterion) - imp(n - nl, p - pl, g.criterion), 9)
            if gain > 1e-9 and (best is None or gain > best[0] + 2e-9):
                best = (gain, int(f), int(c))
    if best is None:
        return node
    below = bins[rows, best[1]] <= best[2]
    return (*best[1:], tree_by_hand(bins, y, w, g, bg._child_path(path, 1), depth + 1, rows[below]),
            tree_by_hand(bins, y, w, g, bg._child_path(path, 2), depth + 1, rows[~below]))


def as_tuple(t, node):
    if t.feature[node] < 0:
        return (int(t.n[node]), int(t.pos[node]))
    return (int(t.feature[node]), int(t.bin[node]), as_tuple(t, t.left[node]), as_tuple(t, t.right[node]))


def bins_of(pdf, cuts):
    return np.column_stack([np.searchsorted(c, pdf[f], side="left") for c, f in zip(cuts, COLS)])


@pytest.mark.parametrize("kw", [dict(criterion="gini", min_leaf=3), dict(criterion="entropy", min_leaf=5, min_split=20), dict(max_depth=2, min_leaf=1)])
def test_trees_and_votes_equal_numpy(spark, planted, monkeypatch, kw):
    df, pdf, row = planted
    monkeypatch.setattr(bg, "SLOTS", 7)  # several passes a level
    g = bg.Growth(trees=4, subset=2, max_bins=16, **kw)
    cuts = bo.collected_cuts(df, COLS, 16)
    rows, _ = bo.binned_table(df, "key", COLS, cuts)
    t = bg.grow(rows, 5, 16, [(0, i) for i in range(4)], g)
    bins, y = bins_of(pdf, cuts), pdf["label"].to_numpy()
    votes, seen = np.zeros(500), np.zeros(500)
    forest = bg.as_forest(t, cuts)
    for i in range(4):
        w = bg.bag_weights(row, i, g.seed)
        assert as_tuple(t, i) == tree_by_hand(bins, y, w, g, np.array([i], dtype=np.uint64))
        out = w == 0
        votes[out] += forest.tree(i, forest.columns(pdf[COLS].to_numpy()))[1][out]
        seen[out] += 1
    got = bg.out_of_bag(rows, t, 5, g.seed).toPandas().sort_values("score")
    some = seen > 0
    want = pd.DataFrame({"s": votes[some] / seen[some], "y": y[some]}).groupby("s")["y"].agg(["sum", "count"])
    assert np.allclose(got["score"], want.index) and (got["n_pos"] == want["sum"].to_numpy()).all()
    assert ((got["n_pos"] + got["n_neg"]) == want["count"].to_numpy()).all()


def test_bags_are_poisson():
    row = np.random.default_rng(1).integers(0, 2 ** 60, 200_000)
    w = np.stack([bg.bag_weights(row, i, 42) for i in range(3)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(w)[0, 1]) < 0.01


def test_forest_learns_and_ranks_features(planted):
    df, pdf, _ = planted
    forest, oob, imp_ = bg.forest(df, "key", COLS, bg.Growth(trees=30, min_leaf=3))
    assert oob["accuracy"] > 0.75 and oob["auc"] > 0.75 and oob["rows"] == 500
    # the fall of impurity at every split, from the numbers in the nodes
    want = np.zeros(5)
    for i, root in enumerate(forest.roots):
        end = forest.roots[i + 1] if i + 1 < len(forest.roots) else len(forest.feature)
        per = np.zeros(5)
        for node in range(root, end):
            if forest.feature[node] >= 0:
                fall = [imp(forest.cover[x], forest.cover[x] * forest.values[x, 1], "gini") for x in (node, forest.left[node], forest.right[node])]
                per[forest.feature[node]] += fall[0] - fall[1] - fall[2]
        want += per / per.sum()
    assert np.allclose(imp_, want / 30, atol=1e-6) and np.argmax(imp_) == 0
    train = (forest.score(pdf[COLS].to_numpy())[1] == pdf["label"]).mean()
    assert train > oob["accuracy"]


def test_grid_equals_separate_forests(planted):
    df, pdf, row = planted
    grid = {"criterion": ["gini", "entropy"], "min_leaf": [3], "max_depth": [2, 4, 0], "min_split": [2, 40], "trees": [2, 5]}
    got = bg.grid_accuracy(df, "key", COLS, "fold", 3, grid, bg.Growth(max_bins=16)).toPandas()
    assert len(got) == 24
    cuts = bo.collected_cuts(df, COLS, 16)
    rows, _ = bo.binned_table(df, "key", COLS, cuts, fold_col="fold")
    for criterion, depth, split, trees in (("gini", 2, 2, 5), ("entropy", 4, 40, 2), ("gini", 0, 40, 5)):
        g = bg.Growth(trees, depth, 3, split, criterion, max_bins=16)
        t = bg.grow(rows, 5, 16, [(m, i) for m in range(3) for i in range(trees)], g)
        acc = []
        for m in range(3):
            part = pdf[pdf["fold"] == m]
            acc.append((bg.as_forest(t, cuts, m).score(part[COLS].to_numpy())[1] == part["label"]).mean())
        hit = got[(got["criterion"] == criterion) & (got["max_depth"] == depth) & (got["min_samples_split"] == split) & (got["n_estimators"] == trees)]
        assert hit["avg_metric"].iloc[0] == pytest.approx(np.mean(acc))


@pytest.mark.parametrize("local", [1, 60, 10_000])
@pytest.mark.parametrize("kw", [dict(criterion="gini", min_leaf=3), dict(criterion="entropy", min_leaf=5, min_split=20), dict(max_depth=3, min_leaf=1)])
def test_small_nodes_grown_in_tasks_equal_the_common_passes(spark, planted, monkeypatch, kw, local):
    df, pdf, _ = planted
    monkeypatch.setattr(bg, "ROW_CHUNK", 40)
    g = bg.Growth(trees=4, subset=2, max_bins=16, **kw)
    cuts = bo.collected_cuts(df, COLS, 16)
    rows, _ = bo.binned_table(df, "key", COLS, cuts)
    t = bg.grow(rows, 5, 16, [(0, i) for i in range(4)], g)
    grown, oob, imp_ = bg.forest(df, "key", COLS, g, local=local)
    assert (len(grown.top.tree) == 4) == (local == 10_000)  # what the driver holds
    joined = bg.joined_trees(grown.top, grown.parts)
    want = np.zeros((4, 5))
    for i in range(4):
        assert as_tuple(joined, i) == as_tuple(t, i)
        split = (t.tree == i) & (t.feature >= 0)
        np.add.at(want[i], t.feature[split], t.gain[split])
    assert np.allclose(imp_, (want / want.sum(axis=1, keepdims=True)).mean(axis=0))
    counts = bg.out_of_bag(rows, t, 5, g.seed).toPandas()
    right = np.where(counts["score"] > 0.5, counts["n_pos"], counts["n_neg"]).sum()
    assert oob["rows"] == counts[["n_pos", "n_neg"]].to_numpy().sum() and oob["accuracy"] == pytest.approx(right / oob["rows"])
    # scored where the subtrees lie: unknown values, nulls, columns beside of any kind
    other = df.withColumn("a", F.col("a") + 3).withColumn("b", F.when(F.col("key") % 9 > 0, F.col("b"))).withColumn("s", F.col("key").cast("string"))
    got = models.score(grown, other, COLS, ("key", "s")).toPandas().sort_values("key")
    x = pdf[pdf["key"] % 9 > 0]
    p, hard = bg.as_forest(t, cuts).score(x.assign(a=x["a"] + 3)[COLS].to_numpy())
    assert (got["s"] == x["key"].astype(str).to_numpy()).all() and np.array_equal(got["score"], p) and np.array_equal(got["prediction"], hard)
    assert models.score(grown, other.limit(0), COLS, ("key", "s")).collect() == []


def test_grid_does_not_depend_on_where_nodes_are_grown(planted):
    df, _, _ = planted
    grid = {"criterion": ["entropy"], "min_leaf": [3], "max_depth": [1, 3, 5, 0], "min_split": [2, 9, 60], "trees": [3, 4]}
    # rules end above the subtrees, inside them and nowhere; the driver holds the upper nodes only
    per = [sorted(map(tuple, bg.grid_accuracy(df, "key", COLS, "fold", 3, grid, bg.Growth(max_bins=16), local=local).collect())) for local in (20, 150, 10_000)]
    assert per[0] == per[1] == per[2] and len(per[0]) == 24 and len({r[-1] for r in per[0]}) > 6


def test_rules_that_no_node_tells_apart_are_one_set():
    # root 0 (10 rows) -> 1 (6) and 2 (4); 1 -> 3, 4
    feature, left, right = np.array([0, 0, -1, -1, -1]), np.array([1, 3, 0, 0, 0]), np.array([2, 4, 0, 0, 0])
    n = np.array([10, 6, 4, 3, 3])
    sets, ends = bg.Stops([(0, 2), (5, 6), (1, 2), (0, 7), (1, 11)]).of(feature, left, right, n, np.zeros(5, dtype=int), np.array([0]))
    assert sets[0] == sets[1] and sets[2] != sets[0]
    assert [ends[s, 3] for s in sets] == [3, 3, 1, 1, 0] and [ends[s, 2] for s in sets] == [2, 2, 2, 2, 0]


def test_walk_ends_where_a_row_by_itself_would():
    rng = np.random.default_rng(8)
    cols = rng.integers(0, 9, (6, 300)).astype(np.uint8)[::2]  # not laid end to end
    feature, left, right = (np.array(v) for v in ([0, -1, 2, 1, -1, -1, -1, -1], [1, 0, 3, 5, 0, 0, 0, 0], [2, 0, 4, 6, 0, 0, 0, 0]))
    cut = np.array([3, 0, 5, 2, 0, 0, 0, 0], dtype=np.uint8)

    def alone(row, at):
        while feature[at] >= 0:
            at = left[at] if cols[feature[at], row] <= cut[at] else right[at]
        return at

    for root in (0, 2, 7):
        assert bg._walk(cols, root, feature.astype(np.int16), cut, left.astype(np.int32), right.astype(np.int32)).tolist() == [alone(r, root) for r in range(300)]
    assert len(bg._walk(cols[:, :0], 0, feature, cut, left, right)) == 0
