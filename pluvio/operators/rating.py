"""Rating curves: the curve in force and the flow read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.columns import MISSING
from pluvio.functions.joins import lookup


def curve_periods(curves: DataFrame) -> DataFrame:
    """Each curve with the start of its successor, so that a time has exactly one curve.

    The window runs over one station's curves, a table of a few dozen rows per station.
    """
    w = Window.partitionBy("station_id").orderBy("start_date", "id")
    return curves.select(
        "station_id", F.col("id").alias("curve_id"), "start_date", F.lead("start_date").over(w).alias("_until")
    )


def _in_force(time: str) -> Column:
    return (F.col("start_date") < F.col(time)) & (F.col("_until").isNull() | (F.col(time) <= F.col("_until")))


def latest_curve_asof(obs: DataFrame, curves: DataFrame) -> DataFrame:
    """Newest curve that started before each reading; null where none had.

    With validity periods each reading matches one curve, so nothing has to be ranked or grouped
    afterwards and the shuffle carries readings once. There are several curves for each station, too many to broadcast
    unless there are few stations.
    """
    rows = lookup(obs, curve_periods(curves), ["station_id"], extra=_in_force("datetime"), shuffled=True)
    return rows.drop("start_date", "_until")


def curve_segments(points: DataFrame) -> DataFrame:
    """Half-open steps [h1, h2) of each curve; the last point is a step of its own."""
    w = Window.partitionBy("rating_curve_id").orderBy("h")
    return points.select(
        F.col("rating_curve_id").alias("curve_id"),
        F.col("h").alias("h1"),
        F.col("q").alias("q1"),
        F.lead("h").over(w).alias("h2"),
        F.lead("q").over(w).alias("q2"),
    )


def rating_curve_flow(levels: DataFrame, curves: DataFrame, points: DataFrame) -> DataFrame:
    """Flow of each level: the table value at an exact level, straight lines in between, -99.9
    outside the table, without a curve or for a missing level.

    Two look-ups of one row each: the curve in force, then the step of that curve.
    """
    h = F.col("measured")
    within = (h != F.lit(MISSING)) & (
        ((h >= F.col("h1")) & (h < F.col("h2"))) | ((h == F.col("h1")) & F.col("h2").isNull())
    )
    rows = lookup(latest_curve_asof(levels, curves), curve_segments(points), ["curve_id"], extra=within, shuffled=True)
    slope = F.try_divide(F.col("q2") - F.col("q1"), F.col("h2") - F.col("h1"))
    line = slope * (h - F.col("h1")) + F.col("q1")
    flow = F.when(h == F.col("h1"), F.col("q1")).otherwise(line)
    return rows.select(*levels.columns, F.coalesce(flow, F.lit(MISSING)).alias("flow"))
