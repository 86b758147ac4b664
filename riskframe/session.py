"""Spark session settings and small helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the shape of the plans in this library:
# AQE re-plans joins and splits skewed partitions at run time, and the
# session time zone is pinned so timestamps compare equal to DuckDB's.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
}

# checkpoint folder of each Spark application, set once
_CHECKPOINT_DIRS: dict[str, str] = {}


def get_session(master: str | None = None, app: str = "riskframe",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return a session; on a cluster the launcher's settings win.

    ``master`` and ``shuffle_partitions`` are only applied when given
    (tests and the bench use ``local[N]``).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = "8g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    if not spark.sparkContext.master.startswith("local"):
        ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not find it where the driver does."""
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="riskframe-package-")  # of the driver; Spark hands the archive out
    archive = os.path.join(folder, "riskframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, set on the context once per application.

    Where the cluster names none, a scratch folder is made on a one-machine
    ``local`` master only; on any other master a missing setting is an error,
    because a machine-local folder would lose data with its executor.
    """
    sc = spark.sparkContext
    known = _CHECKPOINT_DIRS.get(sc.applicationId)
    if known:
        return known
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        # "local-cluster" has separate executors and counts as a cluster
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="riskframe-ckpt-")
    sc.setCheckpointDir(d)
    _CHECKPOINT_DIRS[sc.applicationId] = d
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written_table(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet into the shared checkpoint folder and read again, and where it lies."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written table by the file system that holds it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
