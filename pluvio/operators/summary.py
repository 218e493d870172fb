"""Hourly, daily, monthly, yearly and last-24-hour summaries, and completeness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.columns import (
    DAY_SECONDS,
    accepted,
    effective_value,
    hour_bucket,
    local_day,
    not_missing,
    round_half_up,
    seconds_between,
    shift_seconds,
    to_local,
    ts,
)
from pluvio.schema import SERIES


def value_aggregates(value: str = "_value") -> list[Column]:
    """All five combine partially on the map side, so a hot series shrinks before the shuffle."""
    return [
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.avg(value).alias("avg_value"),
        F.sum(value).alias("sum_value"),
        F.count(value).alias("num_records"),
    ]


def accepted_values(obs: DataFrame) -> DataFrame:
    return obs.withColumn("_value", effective_value()).filter(accepted() & not_missing("_value"))


def between(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Closed time range; written on the stored column so it reaches the scan."""
    if start is not None:
        df = df.filter(F.col(column) >= ts(start))
    if end is not None:
        df = df.filter(F.col(column) <= ts(end))
    return df


def only_stations(df: DataFrame, stations: DataFrame | None) -> DataFrame:
    return df if stations is None else df.join(stations.select("station_id").distinct(), "station_id", "left_semi")


def hourly_summary(
    obs: DataFrame, start: str | None = None, end: str | None = None, stations: DataFrame | None = None
) -> DataFrame:
    """Sub-daily and daily readings are summarised apart; one pass with ``is_daily`` in the key."""
    rows = accepted_values(only_stations(between(obs, "datetime", start, end), stations))
    bucket = F.when(F.col("is_daily"), F.date_trunc("hour", "datetime")).otherwise(hour_bucket())
    return (
        rows.select(bucket.alias("datetime"), *SERIES, "is_daily", "_value")
        .groupBy("datetime", *SERIES, "is_daily")
        .agg(*value_aggregates())
    )


def daily_summary(
    obs: DataFrame,
    station: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    stations: DataFrame | None = None,
) -> DataFrame:
    """Local days of all offsets in one pass; ``[start, end)`` are local days."""
    rows = only_stations(obs, stations)
    if start is not None:
        rows = rows.filter(F.col("datetime") >= ts(f"{start - dt.timedelta(days=1)} 00:00:00"))
    if end is not None:
        rows = rows.filter(F.col("datetime") <= ts(f"{end + dt.timedelta(days=1)} 00:00:00"))
    offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
    days = (
        accepted_values(rows)
        .join(offsets, "station_id")
        .select(local_day().alias("day"), *SERIES, "is_daily", "_value")
    )
    if start is not None:
        days = days.filter(F.col("day") >= F.lit(start))
    if end is not None:
        days = days.filter(F.col("day") < F.lit(end))
    return days.groupBy("day", *SERIES, "is_daily").agg(*value_aggregates())


def last24h_summary(obs: DataFrame, as_of: str) -> DataFrame:
    """One pass: figures skip missing effective values, the latest value skips missing measurements."""
    value = F.col("_value")
    present, measured = not_missing(value), not_missing("measured")
    return (
        obs.filter((F.col("datetime") > shift_seconds(ts(as_of), -DAY_SECONDS)) & (F.col("datetime") <= ts(as_of)))
        .filter((F.col("consisted").isNotNull() | F.col("quality_flag").isin(1, 4)) & ~F.col("is_daily"))
        .withColumn("_value", effective_value())
        .withColumn("_present", F.when(present, value))
        .groupBy(*SERIES)
        .agg(
            *value_aggregates("_present"),
            # fixed-width buffers throughout, so the hash aggregate stays in generated code
            F.max_by("_value", F.when(measured, F.col("datetime"))).alias("latest_value"),
        )
        .filter((F.col("num_records") > 0) & F.col("latest_value").isNotNull())
        .select(
            ts(as_of).alias("datetime"),
            *SERIES,
            "min_value",
            "max_value",
            "avg_value",
            "sum_value",
            "num_records",
            "latest_value",
        )
    )


def _weighted(keys: list[Column], daily: DataFrame) -> DataFrame:
    names = [F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")]
    return daily.groupBy(*keys).agg(
        *names,
        F.try_divide(F.sum("sum_value"), F.sum("num_records")).alias("avg_value"),
        F.sum("sum_value").alias("sum_value"),
        F.sum("num_records").alias("num_records"),
    )


def monthly_summary(daily: DataFrame) -> DataFrame:
    return _weighted(
        [
            F.year("day").alias("year"),
            F.month("day").alias("month"),
            F.trunc("day", "month").alias("date"),
            F.col("station_id"),
            F.col("variable_id"),
        ],
        daily,
    )


def yearly_summary(daily: DataFrame) -> DataFrame:
    return _weighted(
        [
            F.year("day").alias("year"),
            F.trunc("day", "year").alias("date"),
            F.col("station_id"),
            F.col("variable_id"),
        ],
        daily,
    )


def period_summary_unweighted(
    daily: DataFrame, variable: DataFrame, unit: DataFrame, measurement_variable: DataFrame, grain: str = "month"
) -> DataFrame:
    """Every day weighs the same: mean of daily means and number of days."""
    if grain not in ("month", "year"):
        raise ValueError("grain is 'month' or 'year'")
    summary = daily.groupBy(F.trunc("day", grain).alias("date"), *SERIES).agg(
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        round_half_up(F.avg("avg_value"), 6).alias("avg_value"),
        F.sum("sum_value").alias("sum_value"),
        F.count("day").alias("num_days"),
    )
    dims = (
        variable.join(unit.select(F.col("id").alias("unit_id"), F.col("symbol").alias("unit_symbol")), "unit_id")
        .join(
            measurement_variable.select(
                F.col("id").alias("measurement_variable_id"), F.col("name").alias("measurement_variable")
            ),
            "measurement_variable_id",
        )
        .select(F.col("id").alias("variable_id"), F.col("symbol"), "unit_symbol", "measurement_variable")
    )
    return summary.join(dims, "variable_id")


def calendar(keys: DataFrame, first: dt.date, last: dt.date, name: str = "day") -> DataFrame:
    """Each key row once per day of the closed range."""
    return keys.withColumn(name, F.explode(F.sequence(F.lit(first), F.lit(last))))


def completeness_daily(
    obs: DataFrame, station_variable: DataFrame, station: DataFrame, first: dt.date, last: dt.date
) -> DataFrame:
    """Smallest gap to the next reading, number of readings and their share of the ideal, per registered
    pair and local day. Gaps stay inside the day, so the window never spans a whole series."""
    offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
    w = Window.partitionBy(*SERIES, "day").orderBy("datetime")
    per_day = (
        obs.filter(
            (F.col("datetime") > ts(f"{first - dt.timedelta(days=1)} 00:00:00"))
            & (F.col("datetime") <= ts(f"{last + dt.timedelta(days=2)} 00:00:00"))
        )
        .join(offsets, "station_id")
        .select(
            *SERIES, "datetime", "is_daily", F.to_date(shift_seconds(to_local("datetime"), -1)).alias("day")
        )
        .withColumn(
            "_gap",
            F.when(F.col("is_daily"), F.lit(DAY_SECONDS).cast("long")).otherwise(
                seconds_between(F.lead("datetime").over(w), "datetime")
            ),
        )
        .groupBy(*SERIES, "day")
        .agg(F.min("_gap").alias("minimum_interval"), F.count(F.lit(1)).alias("record_count"))
    )
    ideal = F.lit(float(DAY_SECONDS)) / F.nullif(F.col("minimum_interval"), F.lit(0)).cast("double")
    return (
        calendar(station_variable.select(*SERIES), first, last)
        .join(per_day, [*SERIES, "day"], "left")
        .withColumn("record_count", F.coalesce("record_count", F.lit(0)))
        .select(
            "day",
            *SERIES,
            "minimum_interval",
            "record_count",
            F.coalesce(F.round(ideal).cast("int"), F.lit(0)).alias("ideal_record_count"),
            F.coalesce(F.col("record_count") / ideal * 100, F.lit(0.0)).alias("record_count_percentage"),
        )
    )


def monthly_mean_grid(obs: DataFrame, station_variable: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Every month of the span for every registered pair; raw mean without flag or missing filter."""
    months = F.sequence(
        F.lit(dt.date(first_year, 1, 1)), F.lit(dt.date(last_year, 12, 1)), F.expr("interval 1 month")
    )
    means = (
        obs.filter(
            (F.col("datetime") >= ts(f"{first_year}-01-01 00:00:00"))
            & (F.col("datetime") < ts(f"{last_year + 1}-01-01 00:00:00"))
        )
        .groupBy(*SERIES, F.to_date(F.date_trunc("month", "datetime")).alias("month"))
        .agg(round_half_up(F.avg("measured"), 2).alias("mean_value"))
    )
    return (
        station_variable.select(*SERIES)
        .withColumn("month", F.explode(months))
        .join(means, [*SERIES, "month"], "left")
    )


def monthly_mean_margins(grid: DataFrame) -> DataFrame:
    """Row means (per year) and column means (per month of year) over the filled cells."""
    cells = grid.filter("mean_value IS NOT NULL").select(
        *SERIES, F.year("month").alias("year"), F.month("month").alias("month_no"), "mean_value"
    )
    return (
        cells.groupingSets(
            [["station_id", "variable_id", "year"], ["station_id", "variable_id", "month_no"]],
            "station_id",
            "variable_id",
            "year",
            "month_no",
        )
        .agg(round_half_up(F.avg("mean_value"), 2).alias("mean_value"), F.count("mean_value").alias("cells"))
        .withColumn("margin", F.when(F.col("year").isNotNull(), "year").otherwise("month"))
    )
