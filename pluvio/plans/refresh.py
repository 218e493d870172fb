"""Summaries brought up to date after readings changed: persistence first, then every bucket that it or the readings touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.operators import qc, write
from pluvio.schema import KEY

FLAGS = [*qc.PERSIST_RESULT, "quality_flag"]


def with_flags(obs: DataFrame, changed: DataFrame) -> DataFrame:
    """Readings with the flags of the changed ones."""
    new = changed.select(*KEY, F.struct(*FLAGS).alias("_new"))
    flags = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in FLAGS}
    return obs.join(new, KEY, "left").withColumns(flags).select(*obs.columns)


def stale_hours(touched: DataFrame, changed: DataFrame) -> DataFrame:
    """Summary hours to be computed anew: those of the touched readings and of the ones whose flags changed."""
    return write.touched_hour_buckets(touched).union(write.touched_hour_buckets(changed)).distinct()


def stale_days(touched: DataFrame, changed: DataFrame, station: DataFrame) -> DataFrame:
    return write.touched_day_buckets(touched, station).union(write.touched_day_buckets(changed, station)).distinct()


def refresh_hours(obs: DataFrame, touched: DataFrame, limits: DataFrame, hourly: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readings with their new flags, and the hourly summary that belongs to them."""
    changed = qc.qc_persist_refresh(obs, touched, limits)
    flagged = with_flags(obs, changed)
    return flagged, write.recompute_hours(flagged, stale_hours(touched, changed), hourly)
