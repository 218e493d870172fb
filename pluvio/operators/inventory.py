"""Data inventories built on the completeness table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import accepted, at_midnight, day_of_week, round_half_up, slug, trunc_to, ts
from pluvio.schema import SERIES


def _years(completeness: DataFrame, start_year: int, end_year: int) -> DataFrame:
    return completeness.filter(
        (F.col("day") >= F.lit(dt.date(start_year, 1, 1))) & (F.col("day") < F.lit(dt.date(end_year, 1, 1)))
    )


def _share():
    # the mean is settled to six decimals before it is cut, so 33.33 does not turn into 33.32
    return trunc_to(round_half_up(F.avg("record_count_percentage"), 6), 2).alias("percentage")


def inventory_yearly(
    completeness: DataFrame, station: DataFrame, start_year: int, end_year: int, is_automatic: bool | None = None
) -> DataFrame:
    if is_automatic is not None:
        station = station.filter(F.col("is_automatic") == is_automatic)
    # averaged before the join: one row per station and year meets the dimension
    shares = (
        _years(completeness, start_year, end_year)
        .groupBy(F.year("day").alias("year"), "station_id")
        .agg(_share())
    )
    return (
        shares.join(station.withColumnRenamed("id", "station_id"), "station_id")
        .select("year", "station_id", "name", "code", "is_automatic", "begin_date", "watershed", "percentage")
        .orderBy("watershed", "name", "year")
    )


def inventory_by_station(
    completeness: DataFrame,
    station_variable: DataFrame,
    variable: DataFrame,
    start_year: int,
    end_year: int,
) -> DataFrame:
    """Yearly share per registered variable of each station."""
    names = station_variable.select(*SERIES).join(
        variable.select(F.col("id").alias("variable_id"), "name"), "variable_id"
    )
    shares = (
        _years(completeness, start_year, end_year)
        .groupBy(F.year("day").alias("year"), *SERIES)
        .agg(_share())
    )
    return (
        shares.join(names, SERIES)
        .select("year", "station_id", "variable_id", "name", "percentage")
        .orderBy("station_id", "year", "name")
    )


def inventory_monthly(
    completeness: DataFrame, variable: DataFrame, measurement_variable: DataFrame, year: int
) -> DataFrame:
    dims = variable.join(
        measurement_variable.select(F.col("id").alias("measurement_variable_id"), F.col("name").alias("mv")),
        "measurement_variable_id",
        "left",
    ).select(F.col("id").alias("variable_id"), "name", slug("mv").alias("measurement_variable_name"))
    return (
        _years(completeness, year, year + 1)
        .groupBy(F.month("day").alias("month"), *SERIES)
        .agg(_share())
        .join(dims, "variable_id")
    )


def range_count_join(days: DataFrame, obs: DataFrame) -> DataFrame:
    """Readings in the closed range [day, day + 1] per day row, all and accepted ones.

    A reading falls into its own day and, at exact midnight, also closes the day before; so the
    range condition becomes at most two bucket keys per reading and a grouped count.
    """
    own = F.to_date("datetime")
    buckets = F.when(at_midnight("datetime"), F.array(F.date_sub(own, 1), own)).otherwise(F.array(own))
    counts = (
        obs.select(*SERIES, F.explode(buckets).alias("day"), accepted().alias("_ok"))
        .groupBy(*SERIES, "day")
        .agg(F.count(F.lit(1)).alias("qc_amount"), F.count_if("_ok").alias("qc_passed_amount"))
    )
    return days.join(counts, [*SERIES, "day"], "left").fillna(0, ["qc_amount", "qc_passed_amount"])


def inventory_daily(completeness: DataFrame, obs: DataFrame, year: int, month: int) -> DataFrame:
    """31-row sheet per series: completeness and the share of readings that passed quality control.

    Days without a completeness row get their weekday from any day that has one.
    """
    first = dt.date(year, month, 1)
    after = dt.date(year + month // 12, month % 12 + 1, 1)
    days = completeness.filter((F.col("day") >= F.lit(first)) & (F.col("day") < F.lit(after)))
    in_month = obs.filter(
        (F.col("datetime") >= ts(f"{first} 00:00:00")) & (F.col("datetime") <= ts(f"{after} 00:00:00"))
    )
    data = (
        range_count_join(days, in_month)
        .withColumn("day_no", F.dayofmonth("day"))
        .withColumn("dow", day_of_week("day"))
    )
    known = data.groupBy(*SERIES).agg(F.min(F.struct("day_no", "dow")).alias("_known"))
    grid = known.withColumn("day_no", F.explode(F.sequence(F.lit(1), F.lit(31))))
    passed = trunc_to(F.try_divide("qc_passed_amount", "qc_amount") * 100, 2)
    return (
        grid.join(data, [*SERIES, "day_no"], "left")
        .select(
            *SERIES,
            F.col("day_no").alias("day"),
            F.coalesce(
                "dow", F.pmod(F.col("day_no") - F.col("_known.day_no") + F.col("_known.dow"), F.lit(7))
            ).alias("dow"),
            F.coalesce(trunc_to("record_count_percentage", 2), F.lit(0.0)).alias("percentage"),
            F.coalesce("record_count", F.lit(0)).alias("record_count"),
            F.coalesce("ideal_record_count", F.lit(0)).alias("ideal_record_count"),
            F.when(F.col("qc_amount") == 0, F.lit(0.0)).otherwise(passed).alias("qc_passed_percentage"),
        )
    )
