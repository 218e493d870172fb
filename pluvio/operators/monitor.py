"""Station monitoring: communication and quality tracks, maps, last update."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import BAD, DAY_SECONDS, GOOD, SUSPICIOUS, shift_seconds, ts
from pluvio.operators.summary import calendar
from pluvio.schema import SERIES


def hours_band(hours: Column) -> Column:
    return (
        F.when(hours >= 20, "Good").when(hours >= 8, "Suspicious").when(hours >= 1, "Bad").otherwise("Not checked")
    )


def _severity() -> Column:
    """3 bad, 2 suspicious, 1 good, 0 not checked: the worst of a group is the maximum."""
    flag = F.col("quality_flag")
    return F.when(flag == BAD, 3).when(flag == SUSPICIOUS, 2).when(flag == GOOD, 1).otherwise(0)


def _worst_name(severity: Column) -> Column:
    return F.when(severity == 3, "Bad").when(severity == 2, "Suspicious").when(severity == 1, "Good").otherwise("Not checked")


def _with_color(df: DataFrame, flag: DataFrame, name: str) -> DataFrame:
    colors = flag.select(F.col("name").alias(name), "color")
    return df.join(colors, name, "left")


def _flag_counts() -> list[Column]:
    worst = F.col("_worst")
    return [
        F.count_if(worst == 1).alias("good"),
        F.count_if(worst == 2).alias("suspicious"),
        F.count_if(worst == 3).alias("bad"),
        F.count_if(worst == 0).alias("not_checked"),
    ]


def _last_day(df: DataFrame, as_of: str) -> DataFrame:
    return df.filter(
        (F.col("datetime") <= ts(as_of)) & (F.col("datetime") >= shift_seconds(ts(as_of), -DAY_SECONDS))
    )


def _week(df: DataFrame, last: dt.date) -> DataFrame:
    return df.filter(
        (F.col("datetime") >= ts(f"{last - dt.timedelta(days=7)} 00:00:00"))
        & (F.col("datetime") < ts(f"{last + dt.timedelta(days=1)} 00:00:00"))
    )


def comm_daily_track(hourly: DataFrame, station_variable: DataFrame, flag: DataFrame, last: dt.date) -> DataFrame:
    """Hours with data per day over the week ending at ``last``."""
    hours = (
        _week(hourly, last)
        .groupBy(*SERIES, F.to_date("datetime").alias("date"))
        .agg(F.count_distinct(F.hour("datetime")).alias("amount"))
    )
    grid = calendar(station_variable.select(*SERIES), last - dt.timedelta(days=6), last, "date")
    out = grid.join(hours, [*SERIES, "date"], "left").withColumn("amount", F.coalesce("amount", F.lit(0)))
    return _with_color(out.withColumn("_band", hours_band(F.col("amount"))), flag, "_band").drop("_band")


def qc_daily_track(obs: DataFrame, station_variable: DataFrame, last: dt.date) -> DataFrame:
    """Hours per day by their worst flag over the week ending at ``last``."""
    by_hour = (
        _week(obs, last)
        .groupBy(*SERIES, F.to_date("datetime").alias("date"), F.hour("datetime").alias("hour"))
        .agg(F.max(_severity()).alias("_worst"))
    )
    counts = by_hour.groupBy(*SERIES, "date").agg(*_flag_counts())
    grid = calendar(station_variable.select(*SERIES), last - dt.timedelta(days=6), last, "date")
    return grid.join(counts, [*SERIES, "date"], "left").fillna(0, ["good", "suspicious", "bad", "not_checked"])


def _hours_last_day(hourly: DataFrame, as_of: str) -> DataFrame:
    return _last_day(hourly, as_of).groupBy(*SERIES).agg(F.count_distinct(F.hour("datetime")).alias("number_hours"))


def comm_station_vars(
    hourly: DataFrame,
    last24: DataFrame,
    station_variable: DataFrame,
    variable: DataFrame,
    unit: DataFrame,
    flag: DataFrame,
    as_of: str,
) -> DataFrame:
    dims = variable.join(
        unit.select(F.col("id").alias("unit_id"), F.col("symbol").alias("unit_symbol")), "unit_id", "left"
    ).select(F.col("id").alias("variable_id"), "name", "unit_symbol")
    out = (
        station_variable.select(*SERIES)
        .join(_hours_last_day(hourly, as_of), SERIES, "left")
        .join(last24.select(*SERIES, "latest_value"), SERIES, "left")
        .join(dims, "variable_id", "left")
        .withColumn("_band", hours_band(F.coalesce("number_hours", F.lit(0))))
    )
    return _with_color(out, flag, "_band").select(
        *SERIES,
        "name",
        F.coalesce("number_hours", F.lit(0)).alias("amount"),
        "latest_value",
        "unit_symbol",
        "color",
    )


def qc_station_vars(obs: DataFrame, station_variable: DataFrame, variable: DataFrame, as_of: str) -> DataFrame:
    by_hour = (
        _last_day(obs, as_of)
        .groupBy(*SERIES, F.hour("datetime").alias("hour"))
        .agg(F.max(_severity()).alias("_worst"))
    )
    counts = by_hour.groupBy(*SERIES).agg(*_flag_counts())
    return (
        station_variable.select(*SERIES)
        .join(variable.select(F.col("id").alias("variable_id"), "name"), "variable_id", "left")
        .join(counts, SERIES, "left")
        .fillna(0, ["good", "suspicious", "bad", "not_checked"])
    )


def _population(station: DataFrame, as_of: str, on_date: bool) -> DataFrame:
    """Active stations, or those whose validity covers the picked date."""
    if on_date:
        day = F.to_date(ts(as_of))
        keep = (F.col("begin_date") <= day) & (F.col("end_date").isNull() | (F.col("end_date") >= day))
    else:
        keep = F.col("is_active")
    return station.filter(keep).select(
        F.col("id").alias("station_id"), "name", "code", "latitude", "longitude"
    )


def comm_map(
    hourly: DataFrame,
    station: DataFrame,
    station_variable: DataFrame,
    flag: DataFrame,
    as_of: str,
    on_date: bool = False,
) -> DataFrame:
    """Best variable of each station decides its colour."""
    best = (
        station_variable.select(*SERIES)
        .join(_hours_last_day(hourly, as_of), SERIES)
        .groupBy("station_id")
        .agg(F.max("number_hours").alias("_hours"))
    )
    out = (
        _population(station, as_of, on_date)
        .join(best, "station_id", "left")
        .withColumn("_band", hours_band(F.coalesce("_hours", F.lit(0))))
    )
    return _with_color(out, flag, "_band").drop("_band", "_hours")


def qc_map(obs: DataFrame, station: DataFrame, flag: DataFrame, as_of: str, on_date: bool = False) -> DataFrame:
    """Worst flag of the last day decides a station's colour."""
    worst = _last_day(obs, as_of).groupBy("station_id").agg(F.max(_severity()).alias("_worst"))
    out = (
        _population(station, as_of, on_date)
        .join(worst, "station_id", "left")
        .withColumn("_band", _worst_name(F.coalesce("_worst", F.lit(0))))
    )
    return _with_color(out, flag, "_band").drop("_band", "_worst")


def station_last_update(latest: DataFrame) -> DataFrame:
    return latest.groupBy("station_id").agg(
        F.date_format(F.max("last_data_datetime"), "yyyy-MM-dd HH:mm").alias("lastupdate")
    )
