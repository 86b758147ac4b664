"""Aggregations and profiling.

Per-column statistics of a wide table are computed from its long form
``(feature, value)`` so that one shuffle serves every column, and hot
values (a constant column, a dominant level) collapse in the map-side
partial aggregate before anything moves.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import numeric_columns, q
from riskframe.operators.clean import sample_n
from riskframe.plans.prefix import rank_within
from riskframe.session import cut_lineage
from riskframe.plans.reshape import exact_quantiles, to_long, with_group_totals, with_scalar_totals


def quality_table(df: DataFrame, exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """A1: per column type, % missing (1 dp) and distinct non-null count.

    Exact: unpivot to (column, value-as-text), count per distinct pair
    (partial aggregation map-side), then per column; the shuffle carries
    one row per distinct (column, value). ``exact=False`` is one pass with
    HyperLogLog sketches (no shuffle of values) for very wide, very large
    tables where a relative error ``rsd`` on the distinct count is fine.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if not exact:
        row = df.agg(F.count(F.lit(1)).alias("_n"),
                     *[F.count_if(q(c).isNull()).alias(f"m{i}") for i, c in enumerate(types)],
                     *[F.approx_count_distinct(q(c), rsd).alias(f"u{i}") for i, c in enumerate(types)])
        st = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                                          F.round(F.lit(100.0) * F.col(f"m{i}") / F.col("_n"), 1).alias("pct_missing"),
                                          F.col(f"u{i}").cast("bigint").alias("n_unique"))
                                 for i, (c, t) in enumerate(types.items())]))
        return row.select(st.alias("s")).select("s.*")
    vals = []
    for f in df.schema.fields:
        c = q(f.name)
        v = c.cast("string")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            v = F.when(F.isnan(c), F.lit(None)).otherwise(v)
        vals.append(F.struct(F.lit(f.name).alias("column_name"), v.alias("v")))
    long = df.select(F.explode(F.array(*vals)).alias("s")).select("s.column_name", "s.v")
    per_val = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
    per_col = per_val.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("n_missing"),
        F.count("v").alias("n_unique"))
    tmap = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    return per_col.select(
        "column_name", tmap[F.col("column_name")].alias("data_type"),
        F.round(F.lit(100.0) * F.col("n_missing") / F.col("n_rows"), 1).alias("pct_missing"),
        F.col("n_unique").cast("bigint").alias("n_unique"))


def value_counts(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """A2: count and share (×100, ``digits`` dp) per level."""
    # the grand total is one more row of the same pass
    counts = df.select(q(col).alias("value")).rollup("value").agg(F.count(F.lit(1)).alias("n"), F.grouping("value").alias("_all"))
    counts = cut_lineage(counts)
    tot = counts.filter("_all = 1").select(F.col("n").alias("_tot"))
    return with_scalar_totals(counts.filter("_all = 0"), tot).select(
        "value", "n", F.round(F.lit(100.0) * F.col("n") / F.col("_tot"), digits).alias("pct"))


def shape(df: DataFrame) -> DataFrame:
    """A3: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("int"))


SUMMARY_PROBS = [0.25, 0.5, 0.75]


def column_summary(df: DataFrame, cols=None) -> DataFrame:
    """A4: min, quartiles (exact, interpolated), mean, max and NA count per numeric column."""
    cols = cols or numeric_columns(df)
    long = to_long(df, [], cols, drop_nulls=False)
    basic = long.groupBy("feature").agg(
        F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_na"))
    qs = exact_quantiles(long, ["feature"], "value", SUMMARY_PROBS)
    return (basic.join(qs, "feature", "left")
            .select("feature", "min", F.col("q0").alias("q1"), F.col("q1").alias("median"), "mean",
                    F.col("q2").alias("q3"), "max", "n_na"))


def level_summary(df: DataFrame, cols) -> DataFrame:
    """A4 for string columns: count per level."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), q(c).alias("level")) for c in cols])).alias("s"))
    return long.groupBy("s.feature", "s.level").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, cols, bins: int = 10, by: str | None = None) -> DataFrame:
    """Equal-width bin counts per column (and per ``by`` value).

    Bin ``i`` covers ``[lo + i·w, lo + (i+1)·w)``; the last bin includes the maximum.
    """
    ids = [by] if by else []
    long = to_long(df, ids, cols)
    rng = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = with_group_totals(long, rng, ["feature"])
    width = F.col("_hi") - F.col("_lo")
    bin_ = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width * F.lit(bins)), F.lit(bins - 1))
    ).cast("int")
    keys = ["feature"] + ids
    g = j.groupBy(*keys, bin_.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return g.select(*keys, "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "n")


def kde(df: DataFrame, col: str, by: str | list[str] | None = None, grid: int = 64) -> DataFrame:
    """Gaussian kernel density on an even grid from min to max per group.

    Bandwidth is Scott's rule ``sd · n^(-1/5)`` per group. Group statistics
    (one row per group, a bounded broadcast) are joined back and the grid
    sums are one grouped aggregate with ``grid`` sum expressions: one
    pass, no row expansion, partial sums map-side.
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    d = df.select(*[q(k) for k in keys], q(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("x").alias("_sd"),
                              F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    st = st.filter((F.col("_sd") > 0)).withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    j = d.join(st, keys, "inner") if keys else with_scalar_totals(d, st)

    def gp(i):
        return F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.lit(i / (grid - 1))

    sums = [F.sum(F.exp(F.lit(-0.5) * F.pow((gp(i) - F.col("x")) / F.col("_h"), 2))).alias(f"g{i}")
            for i in range(grid)]
    agg = j.groupBy(*keys, "_n", "_h", "_lo", "_hi").agg(*sums)
    norm = F.lit(1.0) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), gp(i).alias("x"),
                                         (F.col(f"g{i}") * norm).alias("density"))
                                for i in range(grid)])).alias("s")
    return agg.select(*keys, stack).select(*keys, F.col("s.i").alias("grid_i"),
                                          F.col("s.x").alias("x"), F.col("s.density").alias("density"))


def kde_binned(df: DataFrame, col: str, by: str | list[str] | None = None, grid: int = 64, cells: int = 4096) -> DataFrame:
    """A7 / T10 at scale: the density of ``kde`` from linear binning, and a ``bound`` of its error.

    A value gives its two neighbouring cell edges the weights of its distance, one grouped sum; the
    kernel then runs over ``cells`` edges a group, however many rows there are. Linear interpolation of
    the kernel over a cell of width δ is off by at most δ²/8 of its greatest curvature 1/(h³·√(2π)).
    """
    keys = [by] if isinstance(by, str) else list(by or [])
    d = df.select(*[q(k) for k in keys], q(col).cast("double").alias("x")).filter(F.col("x").isNotNull())
    st = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp("x").alias("_sd"), F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    st = st.filter(F.col("_sd") > 0).withColumn("_h", F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2)))
    j = d.join(st, keys, "inner") if keys else with_scalar_totals(d, st)
    own = [*keys, "_n", "_h", "_lo", "_hi"]
    at = (F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(cells))
    k = F.least(F.floor(at), F.lit(cells - 1))
    w = j.groupBy(*own, k.alias("_k")).agg(F.sum(F.lit(1.0) - (at - k)).alias("_w0"), F.sum(at - k).alias("_w1"))
    span = (F.col("_hi") - F.col("_lo"))

    def gp(i):
        return F.col("_lo") + span * F.lit(i / (grid - 1))

    def bell(i, edge):
        return F.exp(F.lit(-0.5) * F.pow((gp(i) - (F.col("_lo") + span * edge / F.lit(float(cells)))) / F.col("_h"), 2))

    agg = w.groupBy(*own).agg(*[F.sum(F.col("_w0") * bell(i, F.col("_k")) + F.col("_w1") * bell(i, F.col("_k") + 1)).alias(f"g{i}") for i in range(grid)])
    root = F.lit(math.sqrt(2 * math.pi))
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), gp(i).alias("x"), (F.col(f"g{i}") / (F.col("_n") * F.col("_h") * root)).alias("density"))
                                for i in range(grid)])).alias("s")
    bound = F.pow(span / F.lit(float(cells)), 2) / (F.lit(8.0) * F.pow("_h", 3) * root)
    return agg.select(*keys, bound.alias("bound"), stack).select(
        *keys, F.col("s.i").alias("grid_i"), F.col("s.x").alias("x"), F.col("s.density").alias("density"), "bound")


def kde_all(df: DataFrame, cols, by: str | None = None, grid: int = 64, name: str = "feature", binned: bool = False) -> DataFrame:
    """A7 / T10 for several columns: the density of each, with its name, in one pass over the long form."""
    long = to_long(df, [by] if by else [], cols, name=name, value="value")
    return (kde_binned if binned else kde)(long, "value", [name, *([by] if by else [])], grid)


def box_stats(df: DataFrame, cols, by: str = "label") -> DataFrame:
    """Q1, median, Q3, whiskers at 1.5·IQR and outlier count per (column, group)."""
    long = to_long(df, [by], cols)
    qs = exact_quantiles(long, ["feature", by], "value", SUMMARY_PROBS)
    qs = qs.select("feature", by, F.col("q0").alias("q1"), F.col("q1").alias("median"),
                   F.col("q2").alias("q3"))
    j = with_group_totals(long, qs, ["feature", by])
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = F.col("value").between(lo_f, hi_f)
    return j.groupBy("feature", by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))


def level_counts(df: DataFrame, cols) -> DataFrame:
    """Counts per value of 0/1 columns."""
    long = to_long(df, [], cols, cast="int")
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame) -> DataFrame:
    """A10: one long table per numeric column: type, missing, distinct, quartiles, mean."""
    qt = quality_table(df.select(*[q(c) for c in numeric_columns(df)]))
    cs = column_summary(df)
    return qt.join(cs.withColumnRenamed("feature", "column_name"), "column_name", "left")


def full_profile(df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """A10 over numeric and string columns as one long table (column_name, item, label, value):
    missing share and distinct count (A1), the summary of numeric columns (A4), the ``top`` most
    frequent levels of string columns (a top-n report), and each numeric pair's Spearman rho (C1)."""
    from riskframe.operators.corr import spearman
    nums = [c for c in numeric_columns(df) if c != key]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    none = F.lit(None).cast("string")

    def items(t: DataFrame, name: str, cols) -> DataFrame:
        return t.select(F.col(name).alias("column_name"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("item"), none.alias("label"), F.col(c).cast("double").alias("value")) for c in cols])).alias("s")
        ).select("column_name", "s.*")

    out = items(quality_table(df.drop(key)), "column_name", ["pct_missing", "n_unique"])
    out = out.unionByName(items(column_summary(df, nums), "feature", ["min", "q1", "median", "mean", "q3", "max", "n_na"]))
    levels = level_summary(df, texts).filter(F.col("level").isNotNull())
    # distinct levels of one column in one window: counts, not rows
    turn = Window.partitionBy("feature").orderBy(F.desc("n"), "level")
    out = out.unionByName(levels.withColumn("_r", F.row_number().over(turn)).filter(F.col("_r") <= top).select(
        F.col("feature").alias("column_name"), F.lit("top").alias("item"), F.col("level").alias("label"), F.col("n").cast("double").alias("value")))
    return out.unionByName(spearman(df, key, nums).select(
        F.col("feature_a").alias("column_name"), F.lit("spearman").alias("item"), F.col("feature_b").alias("label"), F.col("rho").alias("value")))


def qq_points(df: DataFrame, col: str, key: str, n: int = 1000) -> DataFrame:
    """Sample quantile vs standard-normal quantile on ``n`` sampled rows.

    Positions are R's ``ppoints``: ``(i - a)/(m + 1 - 2a)``, a = 3/8 if m <= 10 else 1/2.
    """
    s = sample_n(df.select(q(key), q(col).cast("double").alias("x")).filter(F.col("x").isNotNull()),
                 n, key, salt="qq")
    m = s.count()
    a = 0.375 if m <= 10 else 0.5
    r = rank_within(s, [], ["x", key], out="i")
    p = (F.col("i") - F.lit(a)) / F.lit(m + 1 - 2 * a)

    nd = NormalDist()

    @F.pandas_udf(T.DoubleType())
    def inv_norm(ps: pd.Series) -> pd.Series:
        return ps.map(nd.inv_cdf)

    return r.select(F.col("i"), F.col("x").alias("sample_q"), inv_norm(p).alias("theoretical_q"))


def drop_zero_variance(df: DataFrame, cols=None) -> DataFrame:
    """Drop numeric columns whose sample variance is 0 (or undefined)."""
    cols = cols or numeric_columns(df)
    row = df.agg(*[F.var_samp(q(c)).alias(c) for c in cols]).first()
    gone = {c for c in cols if row[c] is None or row[c] == 0 or math.isnan(row[c])}
    return df.select(*[q(c) for c in df.columns if c not in gone])


def levels_by_frequency(df: DataFrame, cols) -> DataFrame:
    """Level rank by count (desc), ties by level text."""
    lc = level_summary(df, cols).filter(F.col("level").isNotNull())
    lc = lc.withColumn("_neg", -F.col("n"))
    r = rank_within(lc, ["feature"], ["_neg", "level"], out="rank")
    return r.drop("_neg")


def schema_report(**named: DataFrame) -> DataFrame:
    """(dataset, column, type, non-null count) for each named table; one pass each."""
    parts = []
    for name, df in named.items():
        types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
        counts = df.agg(*[F.count(q(c)).alias(c) for c, _ in types])
        st = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                                          F.col(f"`{c}`").alias("n_non_null")) for c, t in types]))
        parts.append(counts.select(F.lit(name).alias("dataset"), st.alias("s"))
                     .select("dataset", "s.column_name", "s.data_type", "s.n_non_null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def schema_diff(report: DataFrame, left: str, right: str) -> DataFrame:
    """Columns present in ``left`` but not (with the same type) in ``right``."""
    a = report.filter(F.col("dataset") == left).select("column_name", "data_type")
    b = report.filter(F.col("dataset") == right).select("column_name", "data_type")
    return a.join(b, ["column_name", "data_type"], "left_anti")
