"""Session settings the operators are written for, and the shared working folder."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Runtime settings only; none of them needs a restart, so a session made elsewhere can be adjusted.
RUNTIME = {
    # all stored times are UTC; local time is an explicit offset column
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # a station or variable may own a third of the rows: split its join partitions even if
    # that costs one more shuffle behind the join
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # only the partitions in the written batch are replaced
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # an aggregate that finds few equal keys holds all rows its task reads: so few that it need not spill;
    # as many small files to a task as Spark's own settings give
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.files.openCostInBytes": "512k",
}


# Whether the shuffle files of a job go when it ends; otherwise they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "pluvio") -> SparkSession:
    """Session for tests and the bench; on a cluster the session comes from spark-submit."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="pluvio-")


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``.

    Every executor must be able to read it, so a machine-local folder is accepted only when the
    session itself is local.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _local_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """What a job inside shuffles is removed when it ends: for jobs whose rows are written."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written to the shared folder and read back, so that Spark knows their size."""
    path = shared_dir(df.sparkSession, purpose)
    with cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store Spark reads."""
    system, where = _file_system(spark, path)
    return system.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the library's own tables."""
    system, where = _file_system(spark, path)
    system.delete(where, True)
