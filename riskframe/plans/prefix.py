"""Distributed running sums, running maxima and ranks.

A window ``ORDER BY v`` without ``PARTITION BY`` (or partitioned only by a
feature name) puts every row of the group into one task. ECDFs, AUC,
ROC/PR curves, average ranks and positional splits all need such
running aggregates, so they go through this plan instead:

1. a range exchange on (group, order columns, tie-breaks) cuts the rows
   into slices that respect the order; Spark samples the boundaries and
   finds a row's slice by binary search. All order columns count, so rows
   that tie on the first one are still cut at the next;
2. the sliced rows and their slice number are written once (a reliable
   checkpoint), so every later step, and a task retried after a lost
   executor, sees the same slices;
3. per (group, slice) totals give each slice's offset and the group's total;
4. a window partitioned by (group, slice) computes the local running
   value; ``offset + local`` is the exact global value.

No task ever holds more than one slice of one group. The sampled
boundaries only change how balanced the slices are, never the result.
A null group key is a group like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.session import cut_lineage

SLICE = "_slice"


def with_slices(df: DataFrame, part_cols: list[str], order_cols: list[str], slices: int | None = None) -> DataFrame:
    """Pinned rows with ``_slice``, a number that respects (part_cols, order_cols).

    ``slices`` defaults to the session's shuffle partitions, which the cluster
    sizes to its data; equal rows always share a slice.
    """
    keys = [q(c) for c in (*part_cols, *order_cols)]
    cut = df.repartitionByRange(slices, *keys) if slices else df.repartitionByRange(*keys)
    return cut_lineage(cut.withColumn(SLICE, F.spark_partition_id()))


def _order(cols, descending) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in cols]


def _with_offsets(d: DataFrame, off: DataFrame, part_cols: list[str]) -> DataFrame:
    """Join per-slice values back; null group keys meet null group keys."""
    names = {c: f"_k{i}" for i, c in enumerate([*part_cols, SLICE])}
    off = off.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [q(c).eqNullSafe(F.col(k)) for c, k in names.items()])
    return d.join(off, on).drop(*names.values())


def prefix_sums(df: DataFrame, part_cols: list[str], order_cols: list[str], sum_cols: list[str],
                descending: bool = False, prefix: str = "cum_", n_buckets: int | None = None,
                agg: str = "sum", totals: dict[str, str] | None = None) -> DataFrame:
    """Running ``agg`` (sum or max) of ``sum_cols`` ordered by ``order_cols`` within
    ``part_cols``; rows that tie on every order column share one value (RANGE frame).

    ``totals`` (column -> name) adds the group's whole aggregate, from the same pass.
    """
    fn = {"sum": F.sum, "max": F.max}[agg]
    d = with_slices(df, part_cols, order_cols, n_buckets)
    per = d.groupBy(*[q(c) for c in part_cols], SLICE).agg(*[fn(c).alias(c) for c in sum_cols])
    group = Window.partitionBy(*[q(c) for c in part_cols])
    before = group.orderBy(F.col(SLICE).desc() if descending else F.col(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    off = per.select(*[q(c) for c in part_cols], SLICE, *[fn(c).over(before).alias("_off_" + c) for c in sum_cols],
                     *[fn(c).over(group).alias(t) for c, t in (totals or {}).items()])
    here = Window.partitionBy(*[q(c) for c in part_cols], SLICE).orderBy(*_order(order_cols, descending))
    j = _with_offsets(d.withColumns({"_loc_" + c: fn(c).over(here) for c in sum_cols}), off, part_cols)
    if agg == "sum":
        outs = {prefix + c: F.coalesce(F.col("_off_" + c), F.lit(0)) + F.col("_loc_" + c) for c in sum_cols}
    else:
        outs = {prefix + c: F.greatest(F.col("_off_" + c), F.col("_loc_" + c)) for c in sum_cols}
    return j.withColumns(outs).drop(SLICE, *["_off_" + c for c in sum_cols], *["_loc_" + c for c in sum_cols])


def rank_within(df: DataFrame, part_cols: list[str], order_cols: list[str], out: str = "rn",
                base: int = 1, descending: bool = False, n_buckets: int | None = None) -> DataFrame:
    """Distributed ``row_number`` (offset by ``base``); ``order_cols`` should be unique
    within a group so that the numbering is repeatable."""
    d = with_slices(df, part_cols, order_cols, n_buckets)
    per = d.groupBy(*[q(c) for c in part_cols], SLICE).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*[q(c) for c in part_cols])
    before = group.orderBy(F.col(SLICE).desc() if descending else F.col(SLICE)).rowsBetween(Window.unboundedPreceding, -1)
    off = per.select(*[q(c) for c in part_cols], SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    here = Window.partitionBy(*[q(c) for c in part_cols], SLICE).orderBy(*_order(order_cols, descending))
    j = _with_offsets(d.withColumn("_loc", F.row_number().over(here)), off, part_cols)
    return j.withColumn(out, (F.col("_off") + F.col("_loc") - 1 + base).cast("bigint")).drop(SLICE, "_off", "_loc")


def average_ranks(df: DataFrame, part_cols: list[str], value_col: str, count_col: str = "n",
                  out: str = "avg_rank") -> DataFrame:
    """Average (mid) ranks of distinct values: ``df`` has one row per (group, value)
    with ``count_col`` copies; rank = rows before + (copies + 1) / 2."""
    c = prefix_sums(df, part_cols, [value_col], [count_col], prefix="_cum_")
    return c.withColumn(out, (F.col("_cum_" + count_col) - F.col(count_col)).cast("double")
                        + (F.col(count_col) + F.lit(1)) / F.lit(2.0)).drop("_cum_" + count_col)
