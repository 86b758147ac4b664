"""Distributed running sums, ranks and quantiles against pandas on the same data."""

import numpy as np
import pandas as pd

from pyspark.sql import functions as F

from riskframe.plans.prefix import average_ranks, prefix_sums, rank_within, with_slices
from riskframe.plans.reshape import exact_quantiles


def _data(spark, n=3000, groups=3, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"g": rng.integers(0, groups, n), "v": rng.integers(0, 200, n).astype(float),
                        "w": rng.integers(1, 5, n)})
    return pdf, spark.createDataFrame(pdf)


def test_prefix_sums_many_buckets(spark):
    pdf, df = _data(spark)
    agg = pdf.groupby(["g", "v"], as_index=False)["w"].sum()
    out = prefix_sums(df.groupBy("g", "v").sum("w").withColumnRenamed("sum(w)", "w"),
                      ["g"], ["v"], ["w"], n_buckets=37).toPandas()
    agg["cum"] = agg.sort_values("v").groupby("g")["w"].cumsum()
    m = agg.merge(out, on=["g", "v"])
    assert len(m) == len(agg)
    assert (m["cum"] == m["cum_w"]).all()


def test_prefix_sums_descending_and_global(spark):
    pdf, df = _data(spark, groups=1)
    agg = pdf.groupby("v", as_index=False)["w"].sum()
    out = prefix_sums(df.groupBy("v").sum("w").withColumnRenamed("sum(w)", "w"), [], ["v"], ["w"],
                      descending=True, n_buckets=11).toPandas()
    agg = agg.sort_values("v", ascending=False)
    agg["cum"] = agg["w"].cumsum()
    m = agg.merge(out, on="v")
    assert (m["cum"] == m["cum_w"]).all()


def test_prefix_max(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"i": np.arange(500), "x": rng.normal(size=500)})
    out = prefix_sums(spark.createDataFrame(pdf), [], ["i"], ["x"], agg="max", n_buckets=13).toPandas()
    pdf["best"] = pdf["x"].cummax()
    m = pdf.merge(out, on="i")
    assert np.allclose(m["best"], m["cum_x"])


def test_rank_within_is_dense_and_ordered(spark):
    pdf, df = _data(spark, n=2000)
    pdf = pdf.reset_index().rename(columns={"index": "id"})
    out = rank_within(spark.createDataFrame(pdf), ["g"], ["v", "id"], out="rn", n_buckets=9).toPandas()
    exp = pdf.sort_values(["v", "id"]).groupby("g").cumcount() + 1
    m = pdf.assign(exp=exp).merge(out[["id", "rn"]], on="id")
    assert (m["exp"] == m["rn"]).all()


def test_ties_and_null_groups(spark):
    """90 % of the rows tie on the first order column, and some have no group."""
    n = 4000
    rows = [(None if i % 10 == 0 else i % 3, 5.0 if i % 10 else float(i), i) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, v double, id long")
    out = rank_within(df, ["g"], ["v", "id"], out="rn", n_buckets=16)
    got = {r["id"]: r["rn"] for r in out.collect()}
    for g in (None, 0, 1, 2):
        own = sorted((v, i) for k, v, i in rows if k == g)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    slices = with_slices(df, ["g"], ["v", "id"], 16).groupBy("_slice").count().toPandas()["count"]
    assert slices.max() < 0.25 * n  # the tie is cut at the next column
    sums = prefix_sums(df.withColumn("one", F.lit(1)), ["g"], ["v", "id"], ["one"], n_buckets=16, totals={"one": "all"}).collect()
    assert {(r["g"], r["all"]) for r in sums} == {(g, sum(k == g for k, _, _ in rows)) for g in (None, 0, 1, 2)}
    assert all(r["cum_one"] == got[r["id"]] for r in sums)


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 1), ("a", 3.0, 3)], "feature string, value double, n long")
    r = {row["value"]: row["avg_rank"] for row in average_ranks(df, ["feature"], "value", "n").collect()}
    # values 1,1 | 2 | 3,3,3 -> ranks 1.5 | 3 | 5
    assert r == {1.0: 1.5, 2.0: 3.0, 3.0: 5.0}


def test_exact_quantiles_match_numpy(spark):
    pdf, df = _data(spark, n=1001)
    out = exact_quantiles(df, ["g"], "v", [0.05, 0.25, 0.5, 0.7, 0.95]).toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        exp = np.quantile(sub["v"], [0.05, 0.25, 0.5, 0.7, 0.95])
        assert np.allclose(out.loc[g, ["q0", "q1", "q2", "q3", "q4"]].to_numpy(dtype=float), exp)
