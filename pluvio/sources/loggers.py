"""Logger files: four-line-header CSV, HOBO CSV and semicolon wide CSV.

Header and data lines are told apart by their content, so files are read line by line and a file of
any size is split between tasks; only the one header row per file is joined to its data lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import seconds_between, to_utc
from pluvio.functions.joins import lookup
from pluvio.functions.series import with_previous
from pluvio.sources.lines import (
    clean_line,
    csv_fields,
    file_name,
    first_field,
    mapped_cells,
    station_offsets,
    unquoted,
)

# HOBO columns that repeat daily totals.
HOBO_DAILY_COLUMNS = ["Rain_mm_TOT_24hr", "Rainfall"]


def _readings(cells: DataFrame, local: Column, flag: Column) -> DataFrame:
    return (
        cells.withColumn("datetime", to_utc(local))
        .withColumn("measured", F.col("text").try_cast("double"))
        .filter("measured IS NOT NULL AND datetime IS NOT NULL")
        .select(
            "station_id",
            "variable_id",
            "seconds",
            "datetime",
            "measured",
            flag.alias("quality_flag"),
            F.lit(False).alias("is_daily"),
        )
    )


def ingest_logger_csv(lines: DataFrame, var_format: DataFrame, station: DataFrame) -> DataFrame:
    """The station code is the file name up to the first underscore; names stand in the second line."""
    rows = lines.select("path", clean_line(F.col("line")).alias("line"))
    fields = csv_fields(F.col("line"))
    header = rows.filter(first_field(F.col("line")) == "TIMESTAMP").select("path", fields.alias("names"))
    data = (
        rows.withColumn("local", F.try_to_timestamp(first_field(F.col("line")), F.lit("yyyy-MM-dd HH:mm:ss")))
        .filter("local IS NOT NULL")
        .withColumn("station_code", F.substring_index(file_name(F.col("path")), "_", 1))
        .join(station_offsets(station), "station_code")
    )
    return _readings(mapped_cells(data, header, var_format, fields), F.col("local"), F.lit(1))


def ingest_hobo_csv(lines: DataFrame, var_format: DataFrame, station: DataFrame) -> DataFrame:
    """The title line names the station; column names end at their first comma."""
    rows = lines.select("path", clean_line(F.col("line")).alias("line"))
    line = F.col("line")
    fields = csv_fields(line)
    code = F.substring_index(F.substring_index(F.substring_index(line, "Plot Title:", -1), '"', 1), "_", 1)
    title = (
        rows.filter(line.contains("Plot Title:"))
        .select("path", F.trim(code).alias("station_code"))
        .join(station_offsets(station), "station_code")
    )
    names = F.transform(fields, lambda f: F.substring_index(unquoted(f), ",", 1))
    header = rows.filter(line.contains("Date Time")).select("path", names.alias("names")).join(title, "path")
    second = unquoted(F.substring_index(F.substring_index(line, ",", 2), ",", -1))
    data = rows.withColumn("local", F.try_to_timestamp(second, F.lit("MM/dd/yy hh:mm:ss a"))).filter(
        "local IS NOT NULL"
    )
    cells = mapped_cells(data, header, var_format, fields, HOBO_DAILY_COLUMNS)
    return _readings(cells, F.col("local"), F.lit(None).cast("int"))


def ingest_wide_csv(lines: DataFrame, variable: DataFrame, station: DataFrame) -> DataFrame:
    """``datetime;SYMBOL;...``; the interval is the file's most frequent time step, the smaller one on
    a tie. Times with a zone keep it, others are at the station's offset."""
    rows = lines.select("path", clean_line(F.col("line")).alias("line"))
    line = F.col("line")
    fields = F.split(line, ";", -1)
    header = rows.filter(line.startswith("datetime;")).select("path", fields.alias("names"))
    code = F.substring_index(
        F.substring_index(F.substring_index(file_name(F.col("path")), "_", 2), "_", -1), ".", 1
    )
    data = (
        rows.select(
            "path", "line", code.alias("station_code"), F.substring_index(line, ";", 1).alias("_text")
        )
        .withColumn("_stamp", F.col("_text").try_cast("timestamp"))
        .filter("_stamp IS NOT NULL")
        .join(station_offsets(station), "station_code")
        .withColumn(
            "datetime",
            F.when(F.col("_text").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col("_stamp")).otherwise(to_utc("_stamp")),
        )
        .select("path", "line", "station_id", "datetime")
    )
    steps = (
        with_previous(data.select("path", "datetime"), ["path"], [])
        .groupBy("path", F.coalesce(seconds_between("datetime", "prev_datetime"), F.lit(0)).alias("gap"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("path")
        .agg(F.max_by("gap", F.struct("n", -F.col("gap"))).cast("int").alias("seconds"))
    )
    symbols = variable.select(
        F.col("symbol").alias("lookup_key"), F.col("id").alias("variable_id"), F.lit(None).alias("seconds")
    )
    return (
        lookup(mapped_cells(data, header, symbols, fields).drop("seconds"), steps, ["path"], "inner")
        .withColumn("measured", F.col("text").try_cast("double"))
        .filter("measured IS NOT NULL")
        .select(
            "station_id",
            "variable_id",
            "seconds",
            "datetime",
            "measured",
            F.lit(None).cast("int").alias("quality_flag"),
            F.lit(False).alias("is_daily"),
        )
    )
