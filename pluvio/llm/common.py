"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.session import remove, shared_dir

_SHIPPED: set[str] = set()
# Whether the shuffle files of a job go when it ends; otherwise they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Bytes of rows that Spark sends to a Python worker at once; 64 MB by default, held several times over in both directions.
BATCH = "4m"


def ship(spark: SparkSession) -> None:
    """Sends this library to the Python workers once per application, as --py-files would."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parent.parent
        package = Path(tempfile.mkdtemp(prefix="pluvio-")) / "pluvio.zip"  # served to the workers by the driver
        with zipfile.ZipFile(package, "w") as archive:
            for file in sorted(top.rglob("*.py")):
                archive.write(file, file.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(package))
        _SHIPPED.add(app)


def small_batches(spark: SparkSession) -> None:
    """The session's batches to Python are limited to ``BATCH`` bytes from here on; a longer row goes by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front where the frame has a column of that name already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def kept(df: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors.

    What the write shuffled is removed when it ends: nothing reads it again. A caller that names the folder may remove it.
    """
    spark = df.sparkSession
    path = path or shared_dir(spark, purpose)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Passing:
    """Rows kept for a while: the folder goes when the block ends, so only what is kept inside it may be used after."""

    def __init__(self, df: DataFrame, purpose: str):
        self.df, self.purpose = df, purpose

    def __enter__(self) -> DataFrame:
        self.path = shared_dir(self.df.sparkSession, self.purpose)
        return kept(self.df, self.purpose, self.path)

    def __exit__(self, *_) -> None:
        remove(self.df.sparkSession, self.path)


def text_key(text: Column) -> Column:
    """Two independent 64-bit hashes of a text; with the id they name its row."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
