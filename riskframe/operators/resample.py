"""Splits and resampling.

Every random choice is an md5 draw of a key, so splits are repeatable,
independent of partitioning and identical after a task is retried.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.functions.columns import q
from riskframe.functions.rand import b, b60
from riskframe.plans.prefix import rank_within


def train_test_split(df: DataFrame, key: str, train_share: float = 0.8, salt: str = "split",
                     out: str = "split") -> DataFrame:
    """Not stratified; ``draw < share`` of the whole draw range -> train."""
    return df.withColumn(out, F.when(b(salt, q(key)) < math.ceil(Fraction(str(train_share)) * 2 ** 32), F.lit("train"))
                         .otherwise(F.lit("test")))


def stratified_partition(df: DataFrame, key: str, label: str = "label", share: float = 0.9,
                         salt: str = "strat", out: str = "part") -> DataFrame:
    """R2: within each class, the first ``ceil(share · n_class)`` rows of an md5 order
    go to ``'a'``, the rest to ``'b'``; rows without a label belong to no part (null).
    Ranks are distributed (no class-wide window)."""
    counts = {r[label]: r["n"] for r in df.groupBy(q(label).alias(label))
              .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    cut = F.create_map(*[F.lit(x) for k, n in counts.items() if k is not None
                         for x in (k, math.ceil(Fraction(str(share)) * n))])
    d = df.withColumn("_h", b(salt, q(key)))
    r = rank_within(d, [label], ["_h", key], out="_rn")
    return r.withColumn(out, F.when(q(label).isNull(), F.lit(None)).when(F.col("_rn") <= cut[q(label)], F.lit("a"))
                        .otherwise(F.lit("b"))).drop("_h", "_rn")


def upsample(df: DataFrame, key: str, label: str = "label", minority=1, salt: str = "up") -> DataFrame:
    """Bootstrap the minority class with replacement up to the majority count.

    Minority rows get a dense index ``0..m-1`` (distributed rank over an
    md5 order); draw ``d`` in ``range(n_major)`` (a distributed range)
    picks index ``b(salt, d) % m``; an equi-join fetches the rows. The
    output is majority rows + ``n_major`` drawn minority rows with a
    ``draw`` id (null for majority rows).
    """
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.groupBy(q(label)).count().collect()}  # one row per class
    major = df.filter(q(label) != minority)
    minor = df.filter(q(label) == minority)
    m = counts.get(minority, 0)
    n_major = sum(n for k, n in counts.items() if k is not None and k != minority)
    if m == 0 or n_major == 0:
        return df.withColumn("draw", F.lit(None).cast("bigint"))
    idx = rank_within(minor.withColumn("_h", b(salt + "i", q(key))), [], ["_h", key], out="_idx", base=0).drop("_h")
    draws = spark.range(n_major).select(F.col("id").alias("draw"),
                                        (b60(salt, F.col("id")) % m).alias("_idx"))
    picked = draws.join(idx, "_idx").drop("_idx")
    return major.withColumn("draw", F.lit(None).cast("bigint")).unionByName(picked.select(*major.columns, "draw"))


def kfold(df: DataFrame, key: str, k: int = 5, salt: str = "fold", out: str = "fold") -> DataFrame:
    """fold = md5 bucket mod k (same folds for every trial)."""
    return df.withColumn(out, (b(salt, q(key)) % k).cast("int"))


def positional_split(df: DataFrame, key: str, first_share: float = 0.5, second_share: float = 0.25,
                     salt: str = "perm") -> DataFrame:
    """After a repeatable shuffle (P20), the first ``k1`` rows are ``'first'``,
    the next ``k2`` rows ``'second'``; the rest are dropped."""
    from riskframe.operators.clean import shuffle_rows
    n = df.count()
    k1, k2 = int(n * first_share), int(n * second_share)
    s = shuffle_rows(df, key, salt)
    return (s.filter(F.col("pos") < k1 + k2)
            .withColumn("part", F.when(F.col("pos") < k1, F.lit("first")).otherwise(F.lit("second"))))


def smote(df: DataFrame, key: str, cols, label: str = "label", minority=1, k: int = 5,
          salt: str = "smote", metric: str = "euclidean", round_cols=(), method: str = "exact") -> DataFrame:
    """Synthetic minority rows up to parity.

    Each draw ``d`` in ``range(n_major - m)`` picks a minority row (md5
    index), one of its ``k`` nearest minority neighbours (``knn``; ``method``
    is the caller's choice there) and ``u`` in [0, 1); the new point is
    ``x + u·(nb - x)``, rounded in ``round_cols`` (one-hot columns).
    All joins are equi-joins on (row index), (row, neighbour rank) and
    neighbour id. Output: the input rows (``draw`` null) plus synthetic rows.
    """
    from riskframe.functions.rand import u as unif
    from riskframe.operators.knn import knn
    spark = df.sparkSession
    cols = list(cols)
    minor = df.filter(q(label) == minority)
    counts = {r[0]: r[1] for r in df.groupBy(q(label)).count().collect()}  # one row per class
    m = counts.get(minority, 0)
    n_major = sum(n for c, n in counts.items() if c is not None and c != minority)
    base = df.select(q(key), *[q(c).cast("double").alias(c) for c in cols], q(label)).withColumn(
        "draw", F.lit(None).cast("bigint")).withColumn("neighbor_" + key, F.lit(None).cast(df.schema[key].dataType))
    n_new = n_major - m
    if m < 2 or n_new <= 0:
        return base
    kk = min(k, m - 1)
    nn = knn(minor, minor, key, key, cols, k=kk, metric=metric, exclude_self=True, method=method)
    idx = rank_within(minor.select(q(key), *[q(c) for c in cols]).withColumn("_h", b(salt + "i", q(key))),
                      [], ["_h", key], out="_idx", base=0).drop("_h")
    d = F.col("id")
    draws = spark.range(n_new).select(d.alias("draw"), (b60(salt, d) % m).alias("_idx"),
                                      (b(salt + "n", d) % kk + 1).cast("int").alias("nn_rank"),
                                      unif(salt + "u", d).alias("_u"))
    nb = minor.select(q(key).alias("neighbor_" + key), *[q(c).alias("_nb_" + c) for c in cols])
    j = (draws.join(idx, "_idx").join(nn.select(key, "neighbor_" + key, "nn_rank"), [key, "nn_rank"])
         .join(nb, "neighbor_" + key))
    def between(c):
        v = q(c) + F.col("_u") * (q("_nb_" + c) - q(c))
        return (F.floor(v + F.lit(0.5)).cast("double") if c in round_cols else v).alias(c)

    synth = j.select(q(key), *[between(c) for c in cols],
                     F.lit(minority).cast(df.schema[label].dataType).alias(label), "draw", "neighbor_" + key)
    return base.unionByName(synth)
