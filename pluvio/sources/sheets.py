"""Manual sheets as tables: daily climate, hourly synoptic with coded groups, river level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import MISSING, to_utc
from pluvio.operators.rating import rating_curve_flow

# Daily sheet column -> variable.
DAILY_COLUMNS = {
    "rainfall": 0,
    "temp_min": 14,
    "temp_max": 16,
    "wind_cup_counter": 102,
    "wind_24h_thrown_back": 103,
    "sunshine": 77,
    "evaporation_24h_thrown_back": 40,
    "dry_bulb": 10,
    "wet_bulb": 18,
    "soil_temp_1_foot": 21,
    "soil_temp_4_foot": 23,
    "weather_ts": 104,
    "weather_fog": 106,
    "total_rad": 70,
}

# Synoptic sheet column -> variable.
SYNOPTIC_COLUMNS = {
    "visby": 1000,
    "cldtot": 1001,
    "wnddir": 55,
    "wndspd": 50,
    "tempdb": 10,
    "tempdp": 19,
    "tempwb": 18,
    "relhum": 30,
    "pressl": 61,
    "prswx": 1002,
    "nhamt": 4005,
    "cldcl": 1006,
    "cldcm": 1007,
    "cldch": 1008,
}
# Coded column -> variables of its parts.
CLOUD_GROUPS = {
    "cld1": (1009, 1010, 1011),
    "cld2": (1012, 1013, 1014),
    "cld3": (1015, 1016, 1017),
    "cld4": (1018, 1019, 1020),
}
PAST_WEATHER = {"pastww": (1003, 1004)}
RIVER_LEVEL, STREAM_FLOW = 4015, 4016


def _melt(rows: DataFrame, ids: list[str], columns: dict[str, int]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(v).alias("variable_id"), F.col(c).alias("text")) for c, v in columns.items()])
    return rows.select(*ids, F.inline(cells))


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(MISSING))


def ingest_daily_sheet(
    sheet_rows: DataFrame, station: DataFrame, columns: dict[str, int] | None = None
) -> DataFrame:
    """One row per day; text that is no number becomes -99.9; days the month does not have are dropped."""
    day = F.col("day").try_cast("int")
    valid = day.isNotNull() & (day >= 1) & (day <= F.dayofmonth(F.last_day("month_start")))
    offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
    local = F.date_add(F.col("month_start"), day - 1).cast("timestamp")
    rows = (
        sheet_rows.filter(valid)
        .withColumn("_local", local)
        .join(offsets, "station_id")
        .withColumn("datetime", to_utc("_local"))
    )
    return _melt(rows, ["station_id", "datetime"], columns or DAILY_COLUMNS).select(
        "station_id",
        "variable_id",
        F.lit(86400).alias("seconds"),
        "datetime",
        _number(F.col("text")).alias("measured"),
        F.lit(None).cast("int").alias("quality_flag"),
        F.lit(True).alias("is_daily"),
    )


def _digits(text: Column, width: int) -> Column:
    """Whole number padded with zeros to at least ``width`` digits."""
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def _parts(column: str, variables: tuple[int, ...], cuts: list[tuple[int, int]], width: int) -> list[Column]:
    whole = F.col(column).try_cast("double")
    missing = whole.isNull() | (whole == F.lit(MISSING))
    padded = _digits(whole.cast("bigint").cast("string"), width)
    return [
        F.struct(
            F.lit(variable).alias("variable_id"),
            F.when(missing, F.lit(MISSING))
            .otherwise(F.substring(padded, start, length).cast("double"))
            .alias("measured"),
        )
        for variable, (start, length) in zip(variables, cuts)
    ]


def coded_parts(columns: list[str]) -> Column:
    """Cloud groups: digits 2, 3 and 4-5 of five; past weather: digits 1 and 2 of two."""
    parts: list[Column] = []
    for name in columns:
        if name in CLOUD_GROUPS:
            parts += _parts(name, CLOUD_GROUPS[name], [(2, 1), (3, 1), (4, 2)], 5)
        else:
            parts += _parts(name, PAST_WEATHER[name], [(1, 1), (2, 1)], 2)
    return F.array(*parts)


def split_coded_groups(rows: DataFrame, ids: list[str], columns: list[str] | None = None) -> DataFrame:
    columns = columns or [*CLOUD_GROUPS, *PAST_WEATHER]
    return rows.select(*ids, F.inline(coded_parts(columns)))


def ingest_synoptic_hourly(sheet_rows: DataFrame, station: DataFrame) -> DataFrame:
    """One row per hour; rows without any value are left out, text that is no number becomes -99.9."""
    coded = [*CLOUD_GROUPS, *PAST_WEATHER]
    plain = list(SYNOPTIC_COLUMNS)
    filled = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in plain + coded]
    any_value = filled[0]
    for f in filled[1:]:
        any_value = any_value | f
    hour = F.col("hour").try_cast("int")
    local = F.timestamp_seconds(F.unix_seconds(F.col("day").try_cast("date").cast("timestamp")) + hour * 3600)
    offsets = station.select("code", F.col("id").alias("station_id"), "utc_offset_minutes")
    rows = (
        sheet_rows.filter(hour.between(0, 23) & F.col("day").try_cast("date").isNotNull() & any_value)
        .withColumn("_local", local)
        .join(offsets, F.col("station_code") == F.col("code"))
        .withColumn("datetime", to_utc("_local"))
    )
    plain_cells = [
        F.struct(F.lit(v).alias("variable_id"), _number(F.col(c)).alias("measured"))
        for c, v in SYNOPTIC_COLUMNS.items()
    ]
    return rows.select(
        "station_id", "datetime", F.inline(F.concat(F.array(*plain_cells), coded_parts(coded)))
    ).select(
        "station_id",
        "variable_id",
        F.lit(3600).alias("seconds"),
        "datetime",
        "measured",
        F.lit(None).cast("int").alias("quality_flag"),
        F.lit(False).alias("is_daily"),
    )


def ingest_river_sheet(
    sheet_rows: DataFrame, station: DataFrame, curves: DataFrame, points: DataFrame
) -> DataFrame:
    """Level at 6 and 18 h local time, each with its flow; cells without a number are left out."""
    day = F.col("day").try_cast("int")
    valid = day.isNotNull() & (day >= 1) & (day <= F.dayofmonth(F.last_day("month_start")))
    offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
    cells = F.array(
        F.struct(F.lit(6).alias("hour"), F.col("level_6am").alias("text")),
        F.struct(F.lit(18).alias("hour"), F.col("level_6pm").alias("text")),
    )
    local = F.timestamp_seconds(
        F.unix_seconds(F.date_add("month_start", day - 1).cast("timestamp")) + F.col("hour") * 3600
    )
    levels = (
        sheet_rows.filter(valid)
        .select("station_id", "month_start", "day", F.inline(cells))
        .withColumn("measured", F.col("text").try_cast("double"))
        .filter("measured IS NOT NULL")
        .withColumn("_local", local)
        .join(offsets, "station_id")
        .select("station_id", to_utc("_local").alias("datetime"), "measured")
    )
    both = rating_curve_flow(levels, curves, points)
    cells = F.array(
        F.struct(F.lit(RIVER_LEVEL).alias("variable_id"), F.col("measured").alias("value")),
        F.struct(F.lit(STREAM_FLOW).alias("variable_id"), F.col("flow").alias("value")),
    )
    return both.select("station_id", "datetime", F.inline(cells)).select(
        "station_id",
        "variable_id",
        F.lit(43200).alias("seconds"),
        "datetime",
        F.col("value").alias("measured"),
        F.lit(1).alias("quality_flag"),
        F.lit(False).alias("is_daily"),
    )
