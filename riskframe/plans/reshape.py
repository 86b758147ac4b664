"""Long/wide reshaping, one-row totals and exact quantiles without single-task windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.plans.prefix import prefix_sums


def to_long(df: DataFrame, id_cols, value_cols, name: str = "feature", value: str = "value",
            cast: str = "double", drop_nulls: bool = True) -> DataFrame:
    """Unpivot ``value_cols`` to ``(id..., name, value)`` (one generate, no shuffle)."""
    d = df.select(*[q(c) for c in id_cols], *[q(c).cast(cast).alias(c) for c in value_cols])
    out = d.unpivot(list(id_cols), list(value_cols), name, value)
    return out.filter(F.col(value).isNotNull()) if drop_nulls else out


def with_scalar_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach a one-row aggregate to every row as literals.

    The aggregate is computed by its own small job and collected (one row
    by construction); no join is planned, so nothing can turn into a
    cross join.
    """
    rows = totals.limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"expected a one-row aggregate, got {len(rows)} rows")
    r = rows[0]
    return df.withColumns({f.name: F.lit(r[f.name]).cast(f.dataType) for f in totals.schema.fields})


def with_group_totals(df: DataFrame, totals: DataFrame, keys) -> DataFrame:
    """Attach per-group aggregates. Spark broadcasts the totals if they measure small
    enough; nothing is forced."""
    return df.join(totals, list(keys), "left")


def exact_quantiles(df: DataFrame, part_cols, value_col: str, probs, out_prefix: str = "q") -> DataFrame:
    """Exact ``quantile_cont`` (linear interpolation at ``(n-1)·p``) per group.

    Runs on distinct values with counts plus distributed running counts,
    so no task ever holds a whole group (unlike the ``percentile``
    aggregate, which keeps every distinct value of a group in one map).
    Returns one row per group with columns ``{out_prefix}{i}`` in ``probs`` order.
    """
    part_cols = list(part_cols)
    d = (df.filter(F.col(value_col).isNotNull())
         .groupBy(*part_cols, value_col).agg(F.count(F.lit(1)).alias("_c")))
    c = prefix_sums(d, part_cols, [value_col], ["_c"], prefix="_cum", totals={"_c": "_n"})
    c = c.withColumn("_start", F.col("_cum_c") - F.col("_c")).withColumn("_end", F.col("_cum_c") - 1)
    pos = F.array(*[
        F.struct(F.lit(i).alias("i"),
                 F.floor((F.col("_n") - 1) * F.lit(float(p))).alias("lo"),
                 F.ceil((F.col("_n") - 1) * F.lit(float(p))).alias("hi"),
                 ((F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p)))).alias("fr"))
        for i, p in enumerate(probs)])
    e = (c.select(*part_cols, value_col, "_start", "_end", F.explode(pos).alias("pp"))
         .filter(F.col("pp.lo").between(F.col("_start"), F.col("_end"))
                 | F.col("pp.hi").between(F.col("_start"), F.col("_end"))))
    v = F.col(value_col)
    g = e.groupBy(*part_cols, F.col("pp.i").alias("_i")).agg(
        F.max(F.when(F.col("pp.lo").between(F.col("_start"), F.col("_end")), v)).alias("_vlo"),
        F.max(F.when(F.col("pp.hi").between(F.col("_start"), F.col("_end")), v)).alias("_vhi"),
        F.max("pp.fr").alias("_fr"))
    g = g.withColumn("_q", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_fr"))
    wide = g.groupBy(*part_cols).pivot("_i", list(range(len(probs)))).agg(F.first("_q"))
    return wide.select(*part_cols, *[F.col(str(i)).cast("double").alias(f"{out_prefix}{i}")
                                     for i in range(len(probs))])
