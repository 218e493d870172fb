"""Column statistics under tables, status shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import not_missing, round_half_up
from pluvio.schema import FLAGS


def column_stats_sample(obs: DataFrame, by: list[str]) -> DataFrame:
    """Sum, mean, extremes, sample deviation (0 for a single value) and count."""
    return (
        obs.filter(not_missing("measured"))
        .groupBy(*by)
        .agg(
            F.sum("measured").alias("sum_value"),
            F.avg("measured").alias("avg_value"),
            F.min("measured").alias("min_value"),
            F.max("measured").alias("max_value"),
            F.stddev_samp("measured").alias("_dev"),
            F.count("measured").alias("num_records"),
        )
        .withColumn("std_value", round_half_up(F.coalesce("_dev", F.lit(0.0)), 6))
        .drop("_dev")
    )


def column_stats_population(obs: DataFrame, by: list[str]) -> DataFrame:
    """As above with population deviation and the first time each extreme occurred."""
    lowest = F.min(F.struct(F.col("measured").alias("v"), F.col("datetime").alias("at")))
    # the highest value with the earliest time is the smallest (-value, time)
    highest = F.min(F.struct((-F.col("measured")).alias("v"), F.col("datetime").alias("at")))
    return (
        obs.filter(not_missing("measured"))
        .groupBy(*by)
        .agg(
            F.sum("measured").alias("sum_value"),
            F.avg("measured").alias("avg_value"),
            lowest.alias("_low"),
            highest.alias("_high"),
            round_half_up(F.stddev_pop("measured"), 6).alias("std_value"),
            F.count("measured").alias("num_records"),
        )
        .select(
            *by,
            "sum_value",
            "avg_value",
            F.col("_low.v").alias("min_value"),
            F.col("_low.at").alias("min_datetime"),
            (-F.col("_high.v")).alias("max_value"),
            F.col("_high.at").alias("max_datetime"),
            "std_value",
            "num_records",
        )
    )


def status_share(stations: DataFrame) -> DataFrame:
    """Percent of stations per status colour, colours without stations included.

    One pass counts the fixed colours and the total, and the single row is turned into one per colour.
    """
    cells = [
        F.struct(F.lit(name).alias("name"), F.lit(color).alias("color"), F.col(f"n{i}").alias("stations"))
        for i, _, name, color in FLAGS
    ]
    return (
        stations.agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(F.col("color") == color).alias(f"n{i}") for i, _, _, color in FLAGS],
        )
        .select("total", F.inline(F.array(*cells)))
        .withColumn("percentage", round_half_up(F.try_divide(F.col("stations") * 100.0, F.col("total")), 2))
        .drop("total")
    )
