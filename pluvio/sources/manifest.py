"""File manifest: which waiting files to read and which copies to skip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.functions.joins import lookup

# File states.
NOT_PROCESSED, IN_PROCESS, PROCESSED, ERROR, SKIPPED, REPROCESS = 1, 2, 3, 4, 5, 6


def manifest_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and md5 of every file under ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select(F.col("path").alias("filepath"), F.col("length").alias("file_size"), F.md5("content").alias("file_hash"))
    )


def file_manifest_dedup(manifest: DataFrame) -> DataFrame:
    """Decision for each waiting file.

    A file is skipped while another file with the same content is neither failed nor skipped. Files
    are handled in id order, so of several waiting copies the last one is read. The copies are
    counted per hash (one small row each), never gathered and never broadcast.
    """
    waiting = F.col("status_id").isin(NOT_PROCESSED, REPROCESS)
    queue = manifest.filter(waiting)
    marked = manifest.withColumn("_picked", waiting)
    active = ~F.col("status_id").isin(ERROR, SKIPPED)
    per_hash = marked.groupBy("file_hash").agg(
        F.count_if(active & ~F.coalesce("_picked", F.lit(False))).alias("_active"),
        F.max(F.when(F.coalesce("_picked", F.lit(False)), F.col("id"))).alias("_last"),
    )
    skip = (F.col("_active") > 0) | (F.col("id") != F.col("_last"))
    return (
        # there are about as many contents as files: no copies of their counts; a content copied very often is left to
        # adaptive execution, which splits what is too large for a task
        lookup(queue, per_hash, ["file_hash"], "inner", spread="id", copies=1, shuffled=True)
        .withColumn("decision", F.when(skip, "skip").otherwise("process"))
        .withColumn("new_status_id", F.when(skip, SKIPPED).otherwise(IN_PROCESS))
        .drop("_active", "_last")
    )
