"""A bounded sample of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of each class a classifier is fitted on, at most.
PER_CLASS = 2000
FOLDS = 5


def held_out(id: Column) -> Column:
    """Whether a document's label must not be learnt from; rows without an id have no label."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(label, text) of at most ``PER_CLASS`` documents of each class, and how many labels each class has.

    Held-out rows and null labels never take part; of differing labels of one document the highest counts.
    The rows with the lowest hash of their id are taken, and of several texts of one id the one of the lowest hash, so
    the sample doesn't depend on partitions.
    """
    usable = (
        labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull() & ~held_out(F.col(id)))
        .groupBy(F.col(id).alias("id"))
        .agg((F.max(label) > 0).cast("int").alias("label"))
    )
    totals = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    taken = None
    for kind in (0, 1):
        own = usable.filter(F.col("label") == kind).orderBy(F.xxhash64("id"), "id").limit(PER_CLASS)
        taken = own if taken is None else taken.union(own)
    # at most 2 * PER_CLASS rows of an id and a label
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(taken), "id")
    one = rows.groupBy("id").agg(F.min_by(F.struct("label", "text"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    return one.select("id", "row.label", "row.text"), totals
