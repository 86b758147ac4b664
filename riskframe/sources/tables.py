"""Scans and sinks (S1-S3, S5): parquet test tables, CSV, whitespace matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema=None, infer: bool = False,
             sep: str = ",") -> DataFrame:
    """Header CSV. Prefer an explicit schema; ``infer`` costs a full extra pass."""
    r = spark.read.option("header", True).option("sep", sep)
    if schema is not None:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header CSV, no index column; one file per task (never coalesced to one)."""
    (df.write.mode(mode).option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_matrix(df: DataFrame, path: str, names_path: str, mode: str = "overwrite") -> None:
    """S3 sink: whitespace-separated numeric matrix plus a sidecar table of column names."""
    cols = df.columns
    df.write.mode(mode).option("sep", " ").option("header", False).csv(path)
    spark = df.sparkSession
    (spark.createDataFrame([(i + 1, c) for i, c in enumerate(cols)], "position int, name string")
     .write.mode(mode).parquet(names_path))


def read_matrix(spark: SparkSession, path: str, names_path: str) -> DataFrame:
    """S3 scan: whitespace matrix with names taken from the sidecar table."""
    names = [r["name"] for r in spark.read.parquet(names_path).orderBy("position").collect()]
    schema = ", ".join(f"`{n}` double" for n in names)
    return (spark.read.option("sep", " ").option("header", False)
            .option("ignoreLeadingWhiteSpace", True).schema(schema).csv(path))


def cast_columns(df: DataFrame, cols, to: str = "int") -> DataFrame:
    """Cast a list of columns (``int`` truncates toward zero)."""
    return df.withColumns({c: F.col(f"`{c}`").cast(to) for c in cols})


def persist(df: DataFrame) -> DataFrame:
    """Keep a table that several jobs reuse (unpersist when done)."""
    return df.cache()
