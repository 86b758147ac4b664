"""The histogram booster against numpy, and the properties of its sampling."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting as bo

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 9, 900), np.round(rng.normal(size=900), 2), rng.integers(0, 2, 900), rng.normal(size=900)]).astype(float)
    pdf = pd.DataFrame(x, columns=COLS)
    p = 1 / (1 + np.exp(-(0.6 * (x[:, 0] - 4) + 1.5 * x[:, 1] * (x[:, 2] - 0.5))))
    pdf["label"] = (rng.random(900) < p).astype(int)
    pdf["key"] = np.arange(900)
    pdf["fold"] = pdf["key"] % 3
    return spark.createDataFrame(pdf).repartition(4).persist(), pdf


def cuts_of(v, max_bins):
    values, counts = np.unique(v, return_counts=True)
    part = (np.cumsum(counts) - counts) * max_bins // len(v)
    return np.array([values[part == k].max() for k in np.unique(part)])


def binned(pdf, max_bins):
    cuts = [cuts_of(pdf[c].to_numpy(), max_bins) for c in COLS]
    return cuts, np.column_stack([np.searchsorted(c, pdf[f], side="left") for c, f in zip(cuts, COLS)])


def worth(g, h, p):
    return max(abs(g) - p.reg_alpha, 0) ** 2 / max(h + p.reg_lambda, 1e-12)


def best_cut(bins, g, h, rows, p):
    best = None
    for f in range(bins.shape[1]):
        for c in np.unique(bins[rows, f])[:-1]:
            left = rows[bins[rows, f] <= c]
            right = np.setdiff1d(rows, left)
            if min(h[left].sum(), h[right].sum()) < p.min_child_weight or min(len(left), len(right)) < p.min_data_in_leaf:
                continue
            gain = worth(g[left].sum(), h[left].sum(), p) + worth(g[right].sum(), h[right].sum(), p) - worth(g[rows].sum(), h[rows].sum(), p)
            if best is None or gain > best[0] + 1e-7:
                best = (gain, f, c, left, right)
    return best if best and best[0] > p.gamma else None


def leaf_value(g, h, p):
    return -np.sign(g) * max(abs(g) - p.reg_alpha, 0) / (h + p.reg_lambda)


def depthwise(bins, g, h, rows, p, depth):
    cut = best_cut(bins, g, h, rows, p) if depth < p.max_depth else None
    if cut is None:
        return leaf_value(g[rows].sum(), h[rows].sum(), p)
    return (cut[1], cut[2], depthwise(bins, g, h, cut[3], p, depth + 1), depthwise(bins, g, h, cut[4], p, depth + 1))


def as_tuple(forest, node, cuts):
    f = forest.feature[node]
    if f < 0:
        return forest.values[node, 0]
    return (f, int(np.flatnonzero(cuts[f] == forest.threshold[node])[0]), as_tuple(forest, forest.left[node], cuts), as_tuple(forest, forest.right[node], cuts))


def same(a, b):
    if not isinstance(a, tuple) or not isinstance(b, tuple):
        return not isinstance(a, tuple) and not isinstance(b, tuple) and abs(a - b) < 1e-6
    return a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])


def first_gradients(pdf, p):
    w = np.where(pdf["label"] == 1, p.scale_pos_weight, 1.0)
    return (0.5 - pdf["label"].to_numpy()) * w, 0.25 * w


PARAMS = [dict(max_depth=3), dict(max_depth=3, reg_lambda=5.0, reg_alpha=4.0), dict(max_depth=4, gamma=6.0, min_child_weight=8.0, max_bins=16),
          dict(max_depth=2, scale_pos_weight=3.0, min_data_in_leaf=60)]


@pytest.mark.parametrize("kw", PARAMS)
def test_first_tree_equals_numpy(planted, kw):
    df, pdf = planted
    p = bo.Params(rounds=1, **kw)
    cuts, bins = binned(pdf, p.max_bins)
    got = bo.fit(df, "key", COLS, p).forests[0]
    g, h = first_gradients(pdf, p)
    assert same(as_tuple(got, 0, cuts), depthwise(bins, g, h, np.arange(900), p, 0))


def test_second_tree_follows_the_first(planted):
    df, pdf = planted
    p = bo.Params(rounds=2, max_depth=2, learning_rate=0.3)
    cuts, bins = binned(pdf, p.max_bins)
    got = bo.fit(df, "key", COLS, p).forests[0]
    margin = 0.3 * got.tree(0, got.columns(pdf[COLS].to_numpy()))[0]
    prob = 1 / (1 + np.exp(-margin))
    want = depthwise(bins, prob - pdf["label"].to_numpy(), prob * (1 - prob), np.arange(900), p, 0)
    assert same(as_tuple(got, got.roots[1], cuts), want)


def test_leafwise_takes_the_highest_gains(planted):
    df, pdf = planted
    for leaves in (2, 5, 9):
        p = bo.Params(rounds=1, grow="leaf", num_leaves=leaves, max_depth=0)
        cuts, bins = binned(pdf, p.max_bins)
        got = bo.fit(df, "key", COLS, p)
        g, h = first_gradients(pdf, p)
        open_leaves = [(np.arange(900), best_cut(bins, g, h, np.arange(900), p))]
        while len(open_leaves) < leaves:
            at = max((i for i, x in enumerate(open_leaves) if x[1]), key=lambda i: open_leaves[i][1][0])
            cut = open_leaves.pop(at)[1]
            open_leaves += [(cut[3], best_cut(bins, g, h, cut[3], p)), (cut[4], best_cut(bins, g, h, cut[4], p))]
        forest = got.forests[0]
        assert (forest.feature < 0).sum() == leaves
        assert sorted(forest.cover[forest.feature < 0]) == sorted(len(r) for r, _ in open_leaves)
        want = sorted(leaf_value(g[r].sum(), h[r].sum(), p) for r, _ in open_leaves)
        assert np.allclose(sorted(forest.values[forest.feature < 0, 0]), want, atol=1e-6)


def test_symmetric_level_takes_one_cut(planted):
    df, pdf = planted
    p = bo.Params(rounds=1, grow="symmetric", max_depth=3, reg_lambda=2.0, min_child_weight=0.0)
    cuts, bins = binned(pdf, p.max_bins)
    forest = bo.fit(df, "key", COLS, p).forests[0]
    g, h = first_gradients(pdf, p)
    groups = [np.arange(900)]
    for _ in range(3):
        scored = []
        for f in range(4):
            for c in range(len(cuts[f])):
                parts = [(r[bins[r, f] <= c], r[bins[r, f] > c]) for r in groups]
                scored.append((round(sum(worth(g[x].sum(), h[x].sum(), p) + worth(g[y].sum(), h[y].sum(), p) - worth(g[r].sum(), h[r].sum(), p)
                                         for r, (x, y) in zip(groups, parts) if len(x) and len(y)), 7), -f, -c, parts))
        groups = [x for pair in max(scored, key=lambda s: s[:3])[3] for x in pair]
    assert (forest.feature < 0).sum() == 8
    assert sorted(forest.cover[forest.feature < 0]) == sorted(len(r) for r in groups)
    assert np.allclose(sorted(forest.values[forest.feature < 0, 0]), sorted(leaf_value(g[r].sum(), h[r].sum(), p) for r in groups), atol=1e-6)


def test_result_does_not_depend_on_partitions(planted):
    df, _ = planted
    p = bo.Params(rounds=3, max_depth=3, subsample=0.7, colsample_bytree=0.8, colsample_bylevel=0.7)
    a, b = bo.fit(df.repartition(1), "key", COLS, p).forests[0], bo.fit(df.repartition(7), "key", COLS, p).forests[0]
    assert all(np.array_equal(x, y) for x, y in zip(a[:8], b[:8]))


def test_margins_written_again_change_nothing(planted):
    df, _ = planted
    a = bo.fit(df, "key", COLS, bo.Params(rounds=5, max_depth=2, boosting="dart", skip_drop=0.0, drop_rate=0.4)).forests[0]
    b = bo.fit(df, "key", COLS, bo.Params(rounds=5, max_depth=2, boosting="dart", skip_drop=0.0, drop_rate=0.4, pin_every=2)).forests[0]
    assert np.array_equal(a.feature, b.feature) and np.allclose(a.values, b.values, atol=1e-6) and np.allclose(a.weights, b.weights)


def test_dart_weights(planted):
    df, _ = planted
    p = bo.Params(rounds=6, max_depth=2, boosting="dart", skip_drop=0.0, drop_rate=0.5, learning_rate=0.3)
    got = bo.fit(df, "key", COLS, p)
    w = []
    for n in range(6):
        gone = bo._dropped(p, n, 0, n)
        assert gone or n == 0
        for i in gone:
            w[i] *= len(gone) / (len(gone) + 0.3)
        w.append(0.3 / (len(gone) + 0.3) if gone else 0.3)
    assert np.allclose(got.weights[0], w)


def test_goss_cut_is_exact_and_the_sample_unbiased(planted):
    df, pdf = planted
    rng = np.random.default_rng(3)
    n = 40_000
    row, g = rng.integers(-2 ** 62, 2 ** 62, n), rng.normal(size=n)
    p = bo.Params(boosting="goss", top_rate=0.2, other_rate=0.1)
    cut = int(np.sort(np.rint(np.abs(g) * bo.UNIT))[::-1][int(0.2 * n) - 1])
    sums = [(bo.row_weights(row, g, 0, bo.Round(r, [None], [cut]), p) * g).sum() for r in range(60)]
    spread = np.std(sums) / np.sqrt(60)
    assert abs(np.mean(sums) - g.sum()) < 4 * spread
    w = bo.row_weights(row, g, 0, bo.Round(0, [None], [cut]), p)
    assert (w[np.abs(g) >= cut / bo.UNIT] == 1).all() and set(np.unique(w)) == {0.0, 1.0, 8.0}
    # the distributed cut, with an uneven weight so that gradients differ
    q = bo.Params(rounds=1, boosting="goss", scale_pos_weight=2.5)
    bins = df.select(F.col("key").alias("row"), F.lit(-1).alias("fold"), F.col("label").cast("double"), F.lit(bytearray(b"abcd")).alias("bins"),
                     F.array((F.col("key") % 101 / 37.0).cast("double")).alias("margins"))
    margin = (pdf["key"] % 101 / 37.0).to_numpy()
    grad = np.rint(np.abs(bo.gradients(margin, pdf["label"].to_numpy(), q)[0]) * bo.UNIT)
    assert bo.goss_cut(bins, q, [None], 1, 4) == [int(np.sort(grad)[::-1][179])]


@pytest.mark.parametrize("kw", [dict(), dict(grow="leaf", num_leaves=7), dict(grow="symmetric"), dict(boosting="goss"), dict(boosting="dart")])
def test_every_way_of_boosting_learns(planted, kw):
    df, pdf = planted
    forest = bo.fit(df, "key", COLS, bo.Params(rounds=12, max_depth=3, learning_rate=0.3, **kw)).forests[0]
    score = forest.score(pdf[COLS].to_numpy())[0]
    loss = -np.mean(np.where(pdf["label"] == 1, np.log(score), np.log(1 - score)))
    assert loss < 0.5 < 0.65


def test_folds_grow_together_as_they_would_alone(planted):
    df, pdf = planted
    p = bo.Params(rounds=4, max_depth=3)
    cuts = bo.collected_cuts(df, COLS, p.max_bins)
    both = bo.fit(df, "key", COLS, p, fold_col="fold", models=3, cuts=cuts)
    for m in range(3):
        alone = bo.fit(df.filter(F.col("fold") != m), "key", COLS, p, cuts=cuts).forests[0]
        assert all(np.array_equal(x, y) for x, y in zip(both.forests[m][:8], alone[:8]))


def test_rounds_stop_after_the_best_and_aucs_are_those_of_the_models(planted):
    df, pdf = planted
    p = bo.Params(rounds=30, max_depth=4, learning_rate=0.8, reg_lambda=0.1)
    got = bo.fit(df, "key", COLS, p, fold_col="fold", models=3, patience=3)
    rounds = [r[0] for r in got.history]
    best = next(i for i, r in enumerate(got.history) if r[2])
    assert rounds == list(range(1, len(rounds) + 1)) and len(got.trees[0]) == len(rounds)  # every round fitted is reported
    assert len(rounds) < 30 and len(rounds) - 1 - best == 3 and got.history[-1][3]
    aucs = []
    for m, forest in enumerate(got.forests):
        part = pdf[pdf["fold"] == m]
        s = forest.score(part[COLS].to_numpy())[0]
        pos, neg = s[part["label"] == 1], s[part["label"] == 0]
        aucs.append(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    assert got.history[best][1] == pytest.approx(np.mean(aucs), abs=1e-9)


def test_ordered_statistics_see_earlier_rows_only(spark, planted):
    _, pdf = planted
    t = pdf[["key", "label"]].assign(level=np.where(pdf["a"] > 7, None, (pdf["a"] % 3).astype(str)), other="x")
    df = spark.createDataFrame(t.astype(object).where(t.notna(), None), "key long, label long, level string, other string")
    got = bo.ordered_statistics(df, "key", ["level", "other"]).toPandas().set_index("key")
    draw = {r["key"]: r["h"] for r in df.select("key", bo.b("ts", F.col("key")).alias("h")).collect()}
    for col in ("level", "other"):
        seen = {}
        for _, r in t.assign(h=t["key"].map(draw)).sort_values(["h", "key"]).iterrows():
            y, n = seen.get(r[col], (0, 0))
            assert got.loc[r["key"], col] == pytest.approx((y + 0.5) / (n + 1.0))
            seen[r[col]] = (y + r["label"], n + 1)


def test_encoding_levels(spark, planted):
    _, pdf = planted
    t = pdf[["key", "label"]].assign(two=np.where(pdf["c"] > 0, "u", "v"), many=(pdf["a"]).astype(int).astype(str))
    df = spark.createDataFrame(t)
    train, test, names = bo.encode_levels(df.filter("key >= 100"), df.filter("key < 100").withColumn("many", F.when(F.col("key") == 5, "new").otherwise(F.col("many"))),
                                          "key", ["two", "many"], one_hot_max_size=2)
    assert names == ["two_is_1", "many_rate"] and set(names) <= set(train.columns) and set(names) <= set(test.columns)
    assert train.count() == 800 and test.count() == 100 and test.filter("key = 5").first()["many_rate"] == 0.5
    rates = t[t["key"] >= 100].groupby("many")["label"].agg(["sum", "count"])
    row = test.filter("key = 7").first()
    assert row["many_rate"] == pytest.approx((rates.loc[t.loc[7, "many"], "sum"] + 0.5) / (rates.loc[t.loc[7, "many"], "count"] + 1))


def test_binned_rows_are_written_as_blocks(spark):
    from riskframe.operators import boosting
    df = spark.createDataFrame([(i, float(i % 7), None if i % 10 == 0 else float(i % 3), i % 2, i % 4) for i in range(4000)],
                               "k long, a double, b double, label int, fold int").coalesce(1)
    cuts = boosting.collected_cuts(df, ["a", "b"], 16)
    rows, path = boosting.binned_table(df, "k", ["a", "b"], cuts, fold_col="fold", models=2)
    blocks = rows.toArrow().to_batches()
    assert rows.count() < 100  # arrays of many rows each
    row, fold, label, bins, margins = (np.concatenate(x, axis=-1) for x in zip(*boosting._cells(iter(blocks), 2), strict=True))
    assert bins.shape == (2, 3600) and margins.shape == (2, 3600) and not margins.any() and len(set(row.tolist())) == 3600
    want = sorted((i % 4, i % 2, i % 7, i % 3) for i in range(4000) if i % 10)
    assert sorted(zip(fold.tolist(), label.astype(int).tolist(), *bins.tolist(), strict=True)) == want


def test_passes_recompute_few_trees(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([(i, float(a), float(c), int(a + c + rng.normal() > 0)) for i, (a, c) in enumerate(x)], "key int, a double, b double, label int")
    seen, plain = [], bo.joined
    monkeypatch.setattr(bo, "joined", lambda trees, weights, base, cuts=None: (seen.append(len(trees)) if cuts is None else None) or plain(trees, weights, base, cuts))
    fitted = bo.fit(df, "key", ["a", "b"], bo.Params(rounds=9, max_depth=1))
    assert len(fitted.forests[0].roots) == 9 and max(seen) <= 4  # the written margins hold the others
    apart = bo.fit(df, "key", ["a", "b"], bo.Params(rounds=9, max_depth=1, pin_every=100))
    assert np.allclose(fitted.forests[0].score(x)[0], apart.forests[0].score(x)[0], atol=1e-9)
