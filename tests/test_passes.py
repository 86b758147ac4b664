"""How often rows are read, and what that must not change."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskframe import catalog as c
from riskframe.operators import corr, search, select, svm
from riskframe.plans import gram


def counting(spark, df):
    """``df`` and a number of the rows that were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(parts):
        for p in parts:
            seen.add(len(p))
            yield p
    return df.mapInPandas(run, df.schema), seen


def scored(spark, n=300):
    rng = np.random.default_rng(5)
    rows = [(int(y), float(s), int(s > 0.5)) for y, s in zip(rng.integers(0, 2, n), np.round(rng.random(n), 2))]
    return spark.createDataFrame(rows, "label int, score double, prediction int").repartition(2)


def test_holdout_metrics_score_a_row_once(spark):
    df, seen = counting(spark, scored(spark))
    search.holdout_metrics(df)
    assert seen.value == 300


def test_evaluation_scores_a_row_once(spark, monkeypatch):
    from riskframe.operators import models
    df, seen = counting(spark, scored(spark).withColumns({"model": F.lit("m"), "split": F.lit("test")}))
    monkeypatch.setattr(models, "scored_splits", lambda *a: df)
    monkeypatch.setattr(c._CALL, "held", [], raising=False)
    got = c._eval(None, None, None, [], "m").first()
    assert got["total"] == 300 and seen.value == 300
    for held in c._CALL.held:
        held.unpersist()


def test_screening_builds_its_rows_once(spark):
    rng = np.random.default_rng(3)
    plain = spark.createDataFrame([(float(a), float(b), int(y)) for a, b, y in zip(rng.integers(0, 9, 200), rng.random(200), rng.integers(0, 2, 200))],
                                  "a double, b double, label int").repartition(2)
    df, seen = counting(spark, plain)
    got = {r["feature"]: (r["mv"], r["kf"]) for r in select.mv_sis(df, ["a", "b"]).collect()}
    assert seen.value == 200
    pdf = plain.toPandas()
    for f in "ab":
        ecdf = lambda v, x: np.searchsorted(np.sort(v), x, side="right") / len(v)
        x = pdf[f].to_numpy()
        own = [ecdf(x[pdf["label"] == k], x) for k in (0, 1)]
        share = [(pdf["label"] == k).mean() for k in (0, 1)]
        assert got[f][0] == pytest.approx(sum(p * np.mean((o - ecdf(x, x)) ** 2) for p, o in zip(share, own)))
        assert got[f][1] == pytest.approx(np.abs(own[0] - own[1]).max())


def test_search_draws_are_kept_with_the_rows(spark):
    """The parts of the training rows are read off a column, not drawn again by every pass; no row is lost."""
    from riskframe.functions.rand import b as draw
    sf = "/root/testdata/sf0.001"
    tr, va, test, feats, train = c._val_split(spark, sf)
    val = draw("val", F.col("loan_id")) % 5 == 0
    assert va.filter(~val).count() == 0 and tr.filter(val).count() == 0 and tr.count() + va.count() == train.count()
    assert tr.columns == va.columns == test.columns == train.columns and set(tr.columns) == {"loan_id", "label", *feats}


@pytest.mark.parametrize("looked_up", [0, 4, 10_000])
def test_spearman_equals_pandas(spark, monkeypatch, looked_up):
    monkeypatch.setattr(corr, "LOOKED_UP", looked_up)
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": rng.permutation(400), "a": rng.integers(0, 3, 400).astype(float), "b.x": rng.normal(size=400).round(2),
                        "one": 1.0, "d": rng.normal(size=400)})
    pdf["d"] += pdf["b.x"]
    cols = ["a", "b.x", "one", "d"]
    df = spark.createDataFrame(pdf).repartition(3)
    want = pdf[cols].rank().corr()
    got = corr.spearman(df, "id", cols).collect()
    assert [(r["feature_a"], r["feature_b"]) for r in got] == [(cols[i], cols[j]) for i in range(4) for j in range(i + 1, 4)]
    for r in got:
        x = want.loc[r["feature_a"], r["feature_b"]]
        assert r["rho"] is None if np.isnan(x) else r["rho"] == pytest.approx(x)
    # a row of a repeated key has its place among the ranks, and the key counts once
    twice = pd.concat([pdf, pdf[pdf["id"] % 3 == 0]], ignore_index=True)
    x = twice[cols].rank()[:400].to_numpy() - (len(twice) + 1) / 2
    for r in corr.spearman(spark.createDataFrame(twice).repartition(3), "id", cols).collect():
        a, b = (x[:, cols.index(r[f"feature_{k}"])] for k in "ab")
        assert r["rho"] is None if not (a.any() and b.any()) else r["rho"] == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)))
    # with nulls a pair is correlated over the rows that have both values, by the ranks in the whole column
    holes = pdf.mask(pd.DataFrame({k: (rng.random(400) < 0.2) & (k != "id") for k in pdf.columns}))
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in holes.astype(object).itertuples(index=False)]
    part = spark.createDataFrame(rows, "id bigint, a double, `b.x` double, one double, d double")
    rank = holes[cols].rank()
    for r in corr.spearman(part, "id", cols).collect():
        x = rank[r["feature_a"]].corr(rank[r["feature_b"]])
        assert r["rho"] is None if np.isnan(x) else r["rho"] == pytest.approx(x)


def test_passes_over_blocks_equal_passes_over_rows(spark, monkeypatch):
    monkeypatch.setattr(gram, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    rows = [(float(a), None if i % 10 == 3 else float(b), int(d > 0)) for i, (a, b, d) in enumerate(x)]
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(3)
    both = lambda m: np.concatenate([[len(m)], (m.T @ m).ravel()])
    blocks = gram.row_blocks(df, ["a", "b", "y"])
    assert np.allclose(gram.block_sums(blocks, 3, both), gram.matrix_sums(df, ["a", "b", "y"], both))
    whole = np.array([r for r in rows if r[1] is not None], dtype=float)
    lo, hi = gram.block_ranges(blocks, 3)
    assert np.allclose(lo, whole.min(axis=0)) and np.allclose(hi, whole.max(axis=0))
    assert np.isnan(gram.block_ranges(gram.row_blocks(df.filter("a > 1e9"), ["a"]), 1)[0]).all()


def test_steps_of_a_fit_read_the_rows_once(spark):
    rng = np.random.default_rng(4)
    plain = spark.createDataFrame([(float(a), float(b), int(a + b + e > 0)) for a, b, e in rng.normal(size=(200, 3))], "a double, b double, label int").repartition(2)
    df, seen = counting(spark, plain)
    assert len(svm.squared_hinge(df, ["a", "b"]).objective) > 2 and seen.value == 200
