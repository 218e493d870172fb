"""Day-of-month extremes and means over many years, latest rows, complete rolling sums."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.columns import not_missing, round_half_even
from pluvio.functions.series import complete_rolling_sum
from pluvio.schema import SERIES
from pluvio.operators.summary import between

DAY_OF_MONTH = ["station_id", "variable_id", "month", "day_of_month"]


def _days(daily: DataFrame, month: int | None, first_year: int | None, last_year: int | None) -> DataFrame:
    days = daily
    if month is not None:
        days = days.filter(F.month("day") == month)
    if first_year is not None:
        days = days.filter(F.col("day") >= F.lit(dt.date(first_year, 1, 1)))
    if last_year is not None:
        days = days.filter(F.col("day") < F.lit(dt.date(last_year + 1, 1, 1)))
    return days.select(
        "*", F.month("day").alias("month"), F.dayofmonth("day").alias("day_of_month"), F.year("day").alias("year")
    )


def _extremes(days: DataFrame, value: str, order, mean: bool) -> DataFrame:
    # at most one row per year in a window partition
    same_day = Window.partitionBy(*DAY_OF_MONTH)
    ranked = days.withColumn("_rank", F.rank().over(same_day.orderBy(order))).withColumn(
        "years", F.count(F.lit(1)).over(same_day)
    )
    columns = [*DAY_OF_MONTH, round_half_even(value, 2).alias("agg_value"), "year", "years"]
    if mean:
        ranked = ranked.withColumn("value", round_half_even(F.avg(value).over(same_day), 2))
        columns.append("value")
    return ranked.filter("_rank = 1").select(*columns)


def extremes_accumulation(daily, month=None, first_year=None, last_year=None) -> DataFrame:
    """Greatest daily sum of each day of the month with its year; equal years are all kept."""
    return _extremes(_days(daily, month, first_year, last_year), "sum_value", F.col("sum_value").desc(), False)


def extremes_maximum(daily, month=None, first_year=None, last_year=None) -> DataFrame:
    return _extremes(_days(daily, month, first_year, last_year), "max_value", F.col("max_value").desc(), True)


def extremes_minimum(daily, month=None, first_year=None, last_year=None) -> DataFrame:
    return _extremes(_days(daily, month, first_year, last_year), "min_value", F.col("min_value").asc(), True)


def daily_means(daily, month=None, first_year=None, last_year=None) -> DataFrame:
    return (
        _days(daily, month, first_year, last_year)
        .groupBy(*DAY_OF_MONTH)
        .agg(round_half_even(F.avg("avg_value"), 2).alias("value"))
    )


def extremes_month_summary(extremes: DataFrame, kind: str) -> DataFrame:
    """Line under a month: mean of the day means and the overall extreme with its year.

    The mean runs over the rows of the day table, so a day tied between years counts once per row.
    """
    if kind not in ("accumulation", "maximum", "minimum"):
        raise ValueError(f"unknown kind {kind}")
    sign = F.lit(1.0 if kind == "minimum" else -1.0)
    first = F.min(F.struct((sign * F.col("agg_value")).alias("v"), "day_of_month", "year"))
    aggs = [first.alias("_x"), F.count(F.lit(1)).alias("rows")]
    if kind != "accumulation":
        aggs.append(round_half_even(F.avg("value"), 2).alias("value"))
    out = extremes.groupBy(*SERIES, "month").agg(*aggs)
    return out.select(
        *SERIES,
        "month",
        F.lit(kind).alias("kind"),
        (sign * F.col("_x.v")).alias("agg_value"),
        F.col("_x.year").alias("year"),
        (F.col("value") if kind != "accumulation" else F.lit(None).cast("double")).alias("value"),
    )


def rolling_accumulation(
    obs: DataFrame, period_minutes: int, interval_minutes: int, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Running sum over one interval, kept only where the interval is complete."""
    previous = interval_minutes // period_minutes - 1
    rows = between(obs, "datetime", start, end).filter(not_missing("measured")).select(*SERIES, "datetime", "measured")
    return complete_rolling_sum(rows, SERIES, "measured", previous, interval_minutes * 60).select(
        "datetime", *SERIES, "acc"
    )


def latest_by_rank(obs: DataFrame) -> DataFrame:
    """Newest row of each series; a maximum combines on the map side where a rank would sort."""
    return obs.groupBy(*SERIES).agg(
        F.max("datetime").alias("datetime"), *[F.max_by(c, "datetime").alias(c) for c in ("measured", "code")]
    )
