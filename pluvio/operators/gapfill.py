"""Regular export grids, wide tables and nested chart payloads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import is_coded, pick_listing, to_local, ts
from pluvio.operators.retrieve import TIME_COLUMN
from pluvio.schema import SERIES

MISSING_TEXT = "-99.9"
DEFAULT_STEP_SECONDS = 300


def _grid(pairs: DataFrame, start: Column, end: Column, step: str) -> DataFrame:
    """Every pair at every step of the closed range; for steps of a day and more."""
    return pairs.select(*SERIES, F.explode(F.sequence(start, end, F.expr(f"interval {step}"))).alias("datetime"))


def _fine_grid(pairs: DataFrame, start: str, end: str, step_seconds: int) -> DataFrame:
    """Steps of ``[start, end)``; a row per pair and day first, then that day's steps."""
    first, last = ts(start), F.timestamp_micros(F.unix_micros(ts(end)) - F.lit(1_000_000))
    per_day = max(86400 // step_seconds, 1) * step_seconds
    chunks = pairs.select(
        *SERIES, F.explode(F.sequence(F.unix_seconds(first), F.unix_seconds(last), F.lit(per_day))).alias("_from")
    )
    upto = F.least(F.col("_from") + F.lit(per_day - step_seconds), F.unix_seconds(last))
    return chunks.select(
        *SERIES, F.explode(F.sequence("_from", upto, F.lit(step_seconds).cast("long"))).alias("_at")
    ).select(*SERIES, F.timestamp_seconds("_at").alias("datetime"))


def _registered(station_variable: DataFrame, variables: list[int] | None) -> DataFrame:
    pairs = station_variable.select(*SERIES)
    return pairs if variables is None else pairs.filter(F.col("variable_id").isin(variables))


def export_gapfill_raw(
    obs: DataFrame,
    station_variable: DataFrame,
    variable: DataFrame,
    station: DataFrame,
    start: str,
    end: str,
    step_seconds: int = DEFAULT_STEP_SECONDS,
    variables: list[int] | None = None,
) -> DataFrame:
    """Regular grid of ``[start, end)`` for every registered pair, at local time; gaps read -99.9.

    Readings off the grid are not shown. Values are text because coded variables show their code.
    """
    kinds = variable.select(F.col("id").alias("variable_id"), is_coded().alias("_coded"))
    offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
    text = F.when(F.col("_coded"), F.col("code")).otherwise(F.col("measured").cast("string"))
    found = (
        obs.filter((F.col("datetime") >= ts(start)) & (F.col("datetime") < ts(end)))
        .join(kinds, "variable_id")
        .select(*SERIES, "datetime", text.alias("value"))
    )
    return (
        _fine_grid(_registered(station_variable, variables), start, end, step_seconds)
        .join(found, [*SERIES, "datetime"], "left")
        .join(offsets, "station_id")
        .select(
            *SERIES,
            to_local("datetime").alias("datetime"),
            F.coalesce("value", F.lit(MISSING_TEXT)).alias("value"),
        )
    )


def export_gapfill_summary(
    summary: DataFrame,
    source: str,
    station_variable: DataFrame,
    variable: DataFrame,
    station: DataFrame,
    start: str,
    end: str,
    variables: list[int] | None = None,
) -> DataFrame:
    """Same on hourly, daily, monthly or yearly steps; only hours are shown at local time."""
    at = TIME_COLUMN[source]
    pairs = _registered(station_variable, variables)
    ops = variable.select(F.col("id").alias("variable_id"), "sampling_operation_id")
    if source == "hourly":
        grid = _fine_grid(pairs, start, end, 3600)
        rows = summary.filter((F.col(at) >= ts(start)) & (F.col(at) < ts(end)))
    else:
        first, last = F.to_date(ts(start)), F.to_date(ts(end))
        step, last = {
            "daily": ("1 day", F.date_sub(last, 1)),
            "monthly": ("1 month", last),
            "yearly": ("1 year", last),
        }[source]
        grid = _grid(pairs, first, last, step)
        rows = summary.filter((F.col(at) >= first) & (F.col(at) < F.to_date(ts(end))))
    found = rows.join(ops, "variable_id").select(
        *SERIES, F.col(at).alias("datetime"), pick_listing().alias("value")
    )
    filled = grid.join(found, [*SERIES, "datetime"], "left").withColumn(
        "value", F.coalesce("value", F.lit(-99.9))
    )
    if source == "hourly":
        offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
        filled = filled.join(offsets, "station_id").withColumn("datetime", to_local("datetime"))
    return filled.select(*SERIES, F.col("datetime").cast("timestamp").alias("datetime"), "value")


# Date part columns of an export by source.
DATE_PARTS = {
    "raw": {"Year": "yyyy", "Month": "MM", "Day": "dd", "Time": "HH:mm:ss"},
    "hourly": {"Year": "yyyy", "Month": "MM", "Day": "dd", "Time": "HH:mm:ss"},
    "daily": {"Year": "yyyy", "Month": "MM", "Day": "dd"},
    "monthly": {"Year": "yyyy", "Month": "MM"},
    "yearly": {"Year": "yyyy"},
}


def export_pivot_wide(long: DataFrame, variable: DataFrame, source: str, symbols: list[str]) -> DataFrame:
    """One row per station and period, one column per variable symbol; the first row of a period stays."""
    names = variable.select(F.col("id").alias("variable_id"), "symbol")
    parts = DATE_PARTS[source]
    period = [F.date_format("datetime", pattern).alias(name) for name, pattern in parts.items()]
    cells = [
        F.min(F.when(F.col("symbol") == s, F.struct("datetime", "value")))["value"].alias(s) for s in symbols
    ]
    # the symbols are given, so the pivot needs no extra job to find them
    return long.join(names, "variable_id").groupBy("station_id", *period).agg(*cells)


def series_nested_json(points: DataFrame) -> DataFrame:
    """Chart payload as JSON: measurement variable, variable, then points in time order.

    A payload row holds one station and day, so a long or crowded series spreads over many rows
    instead of gathering in one task.
    """
    point = F.struct("epoch_ms", "value", "flag_name", "flag_color")
    return (
        points.withColumn("day", F.to_date(F.timestamp_millis("epoch_ms")))
        .groupBy("measurement_variable", "variable_symbol", "station_id", "day", "unit_symbol", "color")
        .agg(F.sort_array(F.collect_list(point)).alias("data"))
        .select(
            "measurement_variable",
            "variable_symbol",
            "station_id",
            "day",
            F.to_json(F.struct("color", F.col("unit_symbol").alias("unit"), "data")).alias("payload"),
        )
    )


def export_preamble(
    station: DataFrame,
    variable_label_text: str,
    source_label: str,
    start: str,
    end: str,
    completed: dt.datetime,
    prepared_by: str,
) -> DataFrame:
    """Header lines that go before each station's table."""
    offset = F.col("utc_offset_minutes")

    def local(text: str) -> Column:
        return F.date_format(to_local(ts(text), offset), "yyyy-MM-dd HH:mm:ss")

    lines = F.array(
        F.concat(F.lit("Station:,"), "code", F.lit(" - "), "name"),
        F.lit(f"Data source:,{source_label}"),
        F.lit(f"Description:,{variable_label_text}"),
        F.concat(F.lit("Latitude:,"), F.col("latitude").cast("string")),
        F.concat(F.lit("Longitude:,"), F.col("longitude").cast("string")),
        F.lit(f"Date of completion:,{completed:%Y-%m-%d %H:%M:%S}"),
        F.lit(f"Prepared by:,{prepared_by}"),
        F.concat(F.lit("Start date:,"), local(start), F.lit(",End date:,"), local(end)),
    )
    return station.select(F.col("id").alias("station_id"), F.posexplode(lines).alias("line_no", "line"))


def export_station_csv(wide: DataFrame, path: str) -> None:
    """One CSV folder per station; rows are spread by station and period, so a large station gets
    several files instead of one writer. The number of tasks is given: the time goes by files, and left to
    itself Spark merges the tasks by their few bytes into one that writes all folders."""
    spread = [c for c in ("Year", "Month") if c in wide.columns]
    tasks = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wide.repartition(tasks, "station_id", *spread).sortWithinPartitions(
        "station_id", *[c for c in ("Year", "Month", "Day", "Time") if c in wide.columns]
    ).write.mode("overwrite").partitionBy("station_id").option("header", True).csv(path)
