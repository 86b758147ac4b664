"""Helpers shared by the corpus operators: table scans, written tables, splits, column checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.session import ensure_checkpoint_dir

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder for written tables below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/pins-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written table by the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def pin(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back; ``by`` names a partition column.

    Cuts the lineage like a checkpoint does: later jobs, and tasks retried after
    a lost executor, read the same written rows. Compressed and column-pruned,
    unlike ``checkpoint()`` files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    # the schema is known: no footer-reading job
    return spark.read.schema(df.schema).parquet(path)


def clear_pins(spark: SparkSession) -> None:
    """Delete the tables that this application pinned; results that still read them must be written first."""
    delete_path(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/pins-{spark.sparkContext.applicationId}")


def id_remainder(id_col: Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def power_of_two_at_least(n: int) -> int:
    return 1 << max(0, (max(1, n) - 1).bit_length())


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that know a row by its id and text (nulls included); repeated rows share them."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(i, F.lit(1), t).alias("__k1"), F.xxhash64(t, F.lit(2), i).alias("__k2")]


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              all_copies: bool = False) -> DataFrame:
    """The rows of ``docs`` whose (__k1, __k2) is in ``kept``, with their own columns; one of each
    unless ``all_copies``.

    One exchange: the row number uses the partitioning of the join.
    """
    marked = docs.select("*", *row_keys(id_col, text_col))
    hit = marked.join(kept.select("__k1", "__k2"), ["__k1", "__k2"], "left_semi")
    if all_copies:
        return hit.select(*[f"`{c}`" for c in docs.columns])
    one = Window.partitionBy("__k1", "__k2").orderBy(F.lit(1))
    return (hit.withColumn("__nth", F.row_number().over(one)).filter("__nth = 1")
            .select(*[f"`{c}`" for c in docs.columns]))
