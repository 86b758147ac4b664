"""Boruta's rounds: permutations, shadows, bags and cuts against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import bagged, explain, shadow_rounds as sr
from riskframe.session import delete_path

FEATS = ["a", "b", "c.d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), float(rng.normal()), float(rng.integers(0, 4)), float(i % 7)) for i in range(500)]
    rows += [(1000, 1, None, 1.0, 2.0), (7, 1, 0.25, 3.0, 1.0)]  # left out; a key that comes twice
    return spark.createDataFrame(rows, "id bigint, label int, a double, b double, `c.d` double").repartition(5)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 70000])
def test_every_round_is_a_permutation(n):
    own = [sr.permuted(np.arange(n), n, r) for r in range(3)]
    assert all((np.sort(p) == np.arange(n)).all() for p in own)
    if n > 100:
        assert (own[0] == own[1]).mean() < 0.1
        assert abs(np.corrcoef(own[0], np.arange(n))[0, 1]) < 0.1
        part = np.arange(n)[n // 3: n // 2]  # a block's places do not depend on the other blocks
        assert (sr.permuted(part, n, 1) == own[1][part]).all()


def test_bags_are_poisson_and_differ_by_tree():
    w = sr.bags(np.arange(200_000), 4)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(w, sr.bags(np.arange(200_000), 5))[0, 1]) < 0.02


def test_shadows_are_the_shifted_values(spark, table, monkeypatch):
    monkeypatch.setattr(sr, "BLOCK", 32)
    monkeypatch.setattr(sr, "ORDERED", 50)  # blocks and stretches end at odd places
    rows = sr.binned_rows(table, "id", FEATS, 8)
    n = int(rows.starts[-1])
    assert n == 501 and len(rows.parts) > 10
    whole = np.concatenate([np.frombuffer(r["bins"], dtype=np.uint8).reshape(3, -1) for r in rows.table.orderBy("part").collect()], axis=1)
    want = table.filter("a IS NOT NULL")
    for i, c in enumerate(FEATS):
        counts = sorted(r["n"] for r in want.groupBy(F.col(f"`{c}`")).agg(F.count(F.lit(1)).alias("n")).collect()) if i else None
        assert counts is None or counts == sorted(np.bincount(whole[i]).tolist())
    live, rounds = [0, 2], [3, 8]
    shifts = [explain.shadow_shifts(2, n, r) for r in rounds]
    made, path = sr.shadow_table(rows, live, rounds, shifts)
    got = made.orderBy("part").collect()
    delete_path(spark, path)
    sr.let_go(rows)
    real = np.concatenate([np.frombuffer(r["bins"], dtype=np.uint8).reshape(2, -1) for r in got], axis=1)
    shadows = np.concatenate([np.frombuffer(r["shadows"], dtype=np.uint8).reshape(2, 2, -1) for r in got], axis=2)
    assert (real == whole[live]).all()
    for j, r in enumerate(rounds):
        to = sr.permuted(np.arange(n), n, r)
        for i in range(2):
            expected = np.empty(n, dtype=np.uint8)
            expected[(to + shifts[j][i]) % n] = whole[live[i]]
            assert (shadows[j, i] == expected).all()


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_best_cuts_are_those_of_every_try(criterion):
    rng = np.random.default_rng(2)
    n = rng.integers(0, 4, (6, 3, 5)).astype(float)
    n[:, 1:, -1] += n[:, :1].sum(axis=2) - n[:, 1:].sum(axis=2) + 40
    n[:, 0, -1] += 40  # every feature sees the same rows
    pos = np.zeros_like(n)
    pos[:, :, 0] = np.minimum(n[:, :, 0], 1)
    pos[:, :, -1] = 20 - pos[:, :, :-1].sum(axis=2)
    n[5] = 0
    pos[5] = 0
    drawn = np.tile([2, 5, 9], (6, 1))
    got = sr.best_cuts(n, pos, 10, drawn, bagged.Growth(criterion=criterion)).to_pylist()
    for s, r in enumerate(got):
        every = []
        for f in range(3):
            for c in range(5):
                a, p = n[s, f, :c + 1].sum(), pos[s, f, :c + 1].sum()
                total, plus = n[s, f].sum(), pos[s, f].sum()
                if a and total - a and n[s, f, c]:
                    imp = lambda x, y: float(bagged._impurity(np.array([x]), np.array([y]), criterion)[0])
                    every.append((round(imp(total, plus) - imp(a, p) - imp(total - a, plus - p), 9), -drawn[s, f], -c, a, p))
        assert r["slot"] == 10 + s and r["n"] == n[s, 0].sum()
        if every and max(every)[0] > 1e-9:
            gain, f, c, a, p = max(every)
            assert (r["gain"], r["feature"], r["bin"], r["nl"], r["pl"]) == (pytest.approx(gain, abs=1e-9), -f, -c, a, p)
        else:
            assert r["gain"] is None


def test_splits_between_ends_of_one_class_do_not_count():
    # 0 -> 1, 2; 1 -> 3, 4 (both say 0); 2 -> 5, 6 (0 and 1); 6 -> 7, 8 (both say 1)
    t = bagged.roots([(0, 0)])
    t.tree, t.depth = np.zeros(9, dtype=int), np.array([0, 1, 1, 2, 2, 2, 2, 3, 3])
    t.feature = np.array([0, 1, 2, -1, -1, -1, 0, -1, -1])
    t.left, t.right = np.array([1, 3, 5, 0, 0, 0, 7, 0, 0]), np.array([2, 4, 6, 0, 0, 0, 8, 0, 0])
    t.n, t.pos = np.array([20, 10, 10, 6, 4, 4, 6, 3, 3]), np.array([8, 2, 6, 0, 2, 1, 5, 3, 2])
    assert sr.counted_splits(t).tolist() == [True, False, True, False, False, False, False, False, False]
    t.pos[[5, 2, 0]] = 3, 8, 10  # now all below 2 say 1: it is an end, and its neighbour says 0
    assert sr.counted_splits(t).tolist() == [True] + [False] * 8


def test_importances_are_those_of_sparks_forest(spark):
    from riskframe.operators import models
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(0, 5, 3000), rng.normal(size=3000), rng.integers(0, 2, 3000)]).astype(float)
    y = (rng.random(3000) < np.where((x[:, 0] == 4) & (x[:, 2] == 1), 0.7, 0.1)).astype(int)  # most ends say 0
    df = spark.createDataFrame([(i, *map(float, v), int(c)) for i, (v, c) in enumerate(zip(x, y))], "id bigint, a double, b double, c double, label int").persist()
    rows = sr.binned_rows(df, "id", ["a", "b", "c"])
    got = np.mean(sr.round_importances(rows, [0, 1, 2], [0, 1], [[1000, 2000, 500]] * 2, 40, 4), axis=0)
    sr.let_go(rows)
    own = df.toPandas()
    for i, c in enumerate("abc"):
        own[f"s{i}"] = rng.permutation(own[c].to_numpy())
    cols = ["a", "b", "c", "s0", "s1", "s2"]
    want = models.fit(spark.createDataFrame(own), cols, models.random_forest(80, 4), scaler=None).stages[-1].featureImportances.toArray()
    df.unpersist()
    assert np.abs(got - want).max() < 0.08


def test_rounds_share_their_passes(spark, table):
    sc = spark.sparkContext
    sc.setJobGroup("boruta-passes", "")
    dec, hist = explain.boruta(table, "id", FEATS, max_rounds=6, trees=4, depth=3)
    jobs = len(sc.statusTracker().getJobIdsForGroup("boruta-passes"))
    sc.setJobGroup("", "")
    assert hist.count() == 18 and 0 < jobs < 45  # six fits and rankings of their own took twenty jobs each


def test_rounds_do_not_depend_on_the_layout(table):
    a, b = (sorted(map(tuple, explain.boruta(t, "id", FEATS, max_rounds=2, trees=3, depth=2)[1].collect())) for t in (table, table.repartition(2, "a")))
    assert a == b
