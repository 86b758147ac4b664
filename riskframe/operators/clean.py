"""Projections, filters and cleaning.

Each operator is DataFrame -> DataFrame. Operators whose output schema
depends on the data (P2 drop sparse, P10/P11 one-hot) run exactly one
aggregate pass to learn it and return a lazy plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe.functions.columns import legal_names, numeric_columns, q, string_columns
from riskframe.functions.rand import b
from riskframe.plans.prefix import rank_within

# The reference's loan-status -> binary label recode.
STATUS_TO_LABEL = {
    "Fully Paid": 0,
    "In Grace Period": 0,
    "Current": 0,
    "Charged Off": 1,
    "Late (31-120 days)": 1,
    "Late (16-30 days)": 1,
    "Does not meet the credit policy. Status:Fully Paid": 1,
    "Does not meet the credit policy. Status:Charged Off": 1,
    "Default": 1,
}


def blank_to_null(df: DataFrame, trim: bool = False) -> DataFrame:
    """Empty or whitespace-only strings -> null in every string column.

    ``trim=True`` also strips the kept values (the R variant); the default keeps
    them as they are, so levels such as ' 60 months' survive.
    """
    cols = string_columns(df)
    return df.withColumns({
        c: F.when(F.regexp_like(q(c), F.lit(r"^\s*$")), F.lit(None).cast("string"))
            .otherwise(F.trim(q(c)) if trim else q(c))
        for c in cols})


def null_shares(df: DataFrame) -> dict[str, float]:
    """Share of nulls (and NaN for doubles) per column, in one aggregate pass."""
    exprs = []
    for f in df.schema.fields:
        c = q(f.name)
        miss = c.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(c)
        exprs.append(F.avg(miss.cast("double")).alias(f.name))
    row = df.agg(*exprs).first()
    return {f.name: (row[i] if row[i] is not None else 0.0) for i, f in enumerate(df.schema.fields)}


def drop_sparse_columns(df: DataFrame, max_null_share: float = 0.05) -> DataFrame:
    """Keep columns whose null share is strictly below ``max_null_share``."""
    shares = null_shares(df)
    return df.select(*[q(c) for c in df.columns if shares[c] < max_null_share])


def dropped_columns(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names of removed columns (in original order) plus their count per row."""
    spark = before.sparkSession
    kept = set(after.columns)
    gone = [(i, c) for i, c in enumerate(before.columns) if c not in kept]
    df = spark.createDataFrame(gone, "position int, column_name string")
    return df.withColumn("n_dropped", F.lit(len(gone)).cast("bigint"))


def select_by_type(df: DataFrame, kind: str) -> DataFrame:
    """Numeric, string or one-hot (0/1 integer) columns."""
    if kind == "numeric":
        cols = numeric_columns(df)
    elif kind == "string":
        cols = string_columns(df)
    elif kind == "onehot":
        cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.IntegerType, T.ByteType, T.ShortType))
                and "_" in f.name]
    else:
        raise ValueError(kind)
    return df.select(*[q(c) for c in cols])


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P5."""
    return df.drop(*[c for c in cols if c in df.columns])


def complete_cases(df: DataFrame, subset=None) -> DataFrame:
    """P6 (subset) / P7 (all columns): drop rows with a null or NaN."""
    return df.dropna(how="any", subset=list(subset) if subset else None)


def count_incomplete(df: DataFrame) -> DataFrame:
    """P7 report: rows before, rows with any null, rows after."""
    anynull = None
    for c in df.columns:
        e = q(c).isNull()
        anynull = e if anynull is None else (anynull | e)
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(anynull).alias("n_incomplete")).withColumn(
        "n_complete", F.col("n_rows") - F.col("n_incomplete"))


def _map_expr(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def recode_status(df: DataFrame, col: str = "loan_status", out: str = "label",
                  mapping: dict | None = None) -> DataFrame:
    """Status text -> 0/1 label; unmatched values become null (see P8 report)."""
    m = _map_expr(mapping or STATUS_TO_LABEL)
    return df.withColumn(out, m[q(col)].cast("int")).drop(col) if out != col else \
        df.withColumn(out, m[q(col)].cast("int"))


def unmatched_status(df: DataFrame, col: str = "loan_status", mapping: dict | None = None) -> DataFrame:
    """P8 report: status values with no label and their counts."""
    keys = list((mapping or STATUS_TO_LABEL).keys())
    return (df.filter(~q(col).isin(keys) | q(col).isNull())
            .groupBy(q(col).alias("value")).agg(F.count(F.lit(1)).alias("n")))


def recode_levels(df: DataFrame, maps: dict[str, dict]) -> DataFrame:
    """Explicit per-column level maps (e.g. f/w -> 0/1); unmatched -> null."""
    return df.withColumns({c: _map_expr(m)[q(c)].cast("int") for c, m in maps.items()})


def distinct_levels(df: DataFrame, cols, max_levels: int | None = None) -> dict[str, list]:
    """Sorted non-null levels per column, from one grouped pass.

    Every level becomes a column of the result's schema, so they must reach the
    driver. ``max_levels`` is the caller's own limit: with it, a column that has
    more is refused; there is none by default.
    """
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), q(c).cast("string").alias("v")) for c in cols])).alias("s"))
    levels = long.filter("s.v is not null").groupBy("s.c", "s.v").agg(F.count(F.lit(1)).alias("n"))
    if max_levels is not None:
        for r in levels.groupBy("c").count().filter(F.col("count") > max_levels).collect():
            raise ValueError(f"column {r['c']!r} has {r['count']} levels (> {max_levels})")
    out: dict[str, list] = {c: [] for c in cols}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for r in levels.select("c", "v").collect():
        out[r["c"]].append(int(r["v"]) if isinstance(kinds[r["c"]], T.IntegralType) else r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, cols, drop_first: bool = True, levels: dict | None = None,
            keep_original: bool = False) -> DataFrame:
    """P10 (drop first level) / P11 (all levels): ``col_level`` 0/1 INT columns.

    New columns take the place of the source column; levels are sorted.
    """
    levels = levels or distinct_levels(df, cols)
    sel = []
    for c in df.columns:
        if c not in cols:
            sel.append(q(c))
            continue
        if keep_original:
            sel.append(q(c))
        lv = levels[c][1:] if drop_first else levels[c]
        for v in lv:
            sel.append((q(c) == F.lit(v)).cast("int").alias(f"{c}_{v}"))
    return df.select(*sel)


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row dedupe (hash aggregate, partial map-side)."""
    return df.dropDuplicates()


def sample_n(df: DataFrame, n: int, key: str, salt: str = "sample") -> DataFrame:
    """Exactly ``n`` rows uniformly without replacement, repeatable.

    Ordering by an md5 draw of the key and keeping the first ``n`` is a
    top-n (per-partition top-n, then merge), so only n rows per task move.
    """
    return (df.withColumn("_h", b(salt, q(key))).orderBy("_h", key).limit(n).drop("_h"))


def concat_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Side-by-side glue as a key join (never by physical row order)."""
    return left.join(right, on=key, how="inner")


def union_rows(*dfs: DataFrame) -> DataFrame:
    """P15."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def split_by_class(df: DataFrame, label: str = "label"):
    """(majority-label-0 rows, label-1 rows)."""
    return df.filter(q(label) == 0), df.filter(q(label) == 1)


def legalize_names(df: DataFrame) -> DataFrame:
    """Legal, unique column names."""
    return df.toDF(*legal_names(df.columns))


def label_last(df: DataFrame, label: str = "label") -> DataFrame:
    """P18 helper: label as the last column."""
    return df.select(*[q(c) for c in df.columns if c != label], q(label))


def label_features(df: DataFrame, label: str = "loan_status", exclude=()) -> DataFrame:
    """Label first (named ``label``), remaining columns as features."""
    feats = [c for c in df.columns if c != label and c not in exclude]
    return df.select(q(label).alias("label"), *[q(c) for c in feats])


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by key (top-n)."""
    return df.orderBy(key).limit(n)


def shuffle_rows(df: DataFrame, key: str, salt: str = "perm") -> DataFrame:
    """P20: repeatable random permutation with its position ``pos`` (0-based).

    The position comes from a distributed rank (range buckets + offsets),
    not a single-partition window.
    """
    d = df.withColumn("_h", b(salt, q(key)))
    return rank_within(d, [], ["_h", key], out="pos", base=0).drop("_h")


def threshold_decision(df: DataFrame, prob_col: str = "probability_1", out: str = "prediction",
                       threshold: float = 0.5, digits: int = 2) -> DataFrame:
    """round(p, digits) > threshold -> 1 else 0."""
    return df.withColumn(out, F.when(F.round(q(prob_col), digits) > F.lit(threshold), 1).otherwise(0))


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P22."""
    return df.withColumnsRenamed(mapping)

