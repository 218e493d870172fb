"""Sea level at high frequency: window statistics and wave components; inputs and labels of the
rain prediction."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import micros, positive_degrees
from pluvio.functions.joins import lookup
from pluvio.operators.climatology import rolling_accumulation
from pluvio.schema import KEY, SERIES

# Accepted frequencies in Hz and smallest amplitude.
MIN_FREQUENCY, MAX_FREQUENCY, MIN_AMPLITUDE = 0.0001, 0.3, 0.01
TOP_COMPONENTS = 5


def _window_end(at: str, minutes: int, start: str | None) -> Column:
    width = minutes * 60_000_000
    origin = F.unix_micros(F.to_timestamp(F.lit(start))) if start else F.lit(0)
    end = F.ceil((micros(at) - origin) / F.lit(width)) * F.lit(width) + origin
    return F.timestamp_micros(end.cast("bigint"))


def in_windows(hf: DataFrame, minutes: int, start: str | None = None) -> DataFrame:
    """Adds ``window_end`` of the tumbling window (end - minutes, end] each reading falls into."""
    return hf.withColumn("window_end", _window_end("datetime", minutes, start))


def hf_window_stats(windowed: DataFrame) -> DataFrame:
    """Minimum, maximum, mean, deviation and significant wave height of each window, one row each."""
    stats = windowed.groupBy(*SERIES, "window_end").agg(
        F.min("measured").alias("lo"),
        F.max("measured").alias("hi"),
        F.avg("measured").alias("mean"),
        F.stddev_pop("measured").alias("dev"),
    )
    cells = F.array(
        F.struct(F.lit("Sea Level [MIN]").alias("name"), F.col("lo").alias("measured")),
        F.struct(F.lit("Sea Level [MAX]").alias("name"), F.col("hi").alias("measured")),
        F.struct(F.lit("Sea Level [AVG]").alias("name"), F.col("mean").alias("measured")),
        F.struct(F.lit("Sea Level [STDV]").alias("name"), F.col("dev").alias("measured")),
        F.struct(F.lit("Significant Wave Height").alias("name"), (F.col("dev") * 4).alias("measured")),
    )
    return stats.select(*SERIES, F.col("window_end").alias("datetime"), F.inline(cells))


def wave_components(windowed: DataFrame, components: int = TOP_COMPONENTS, remove_mean: bool = True) -> DataFrame:
    """Strongest waves of each window as (rank, frequency, amplitude, phase).

    The transform needs a window's samples in order at once; a window is at most ``minutes`` long,
    so a group stays a few thousand rows however long or busy the series is.
    """

    def strongest(pdf: pd.DataFrame) -> pd.DataFrame:
        data = pdf.sort_values("datetime")["measured"].to_numpy()
        n = len(data)
        spectrum = np.fft.rfft(data - data.mean() if remove_mean else data)
        frequency = np.arange(len(spectrum)) / n
        amplitude = 2 * np.abs(spectrum) / n
        keep = np.flatnonzero(
            (frequency >= MIN_FREQUENCY) & (frequency <= MAX_FREQUENCY) & (amplitude >= MIN_AMPLITUDE)
        )
        top = keep[np.argsort(-amplitude[keep], kind="stable")][:components]
        first = pdf.iloc[0]
        return pd.DataFrame(
            {
                "station_id": first["station_id"],
                "variable_id": first["variable_id"],
                "datetime": first["window_end"],
                "component": np.arange(1, len(top) + 1),
                "frequency": frequency[top],
                "amplitude": amplitude[top],
                "phase_rad": np.angle(spectrum[top]) + np.pi / 2,
            }
        )

    return (
        windowed.select(*SERIES, "datetime", "measured", "window_end")
        .groupBy(*SERIES, "window_end")
        .applyInPandas(
            strongest,
            "station_id int, variable_id int, datetime timestamp, component int, frequency double,"
            " amplitude double, phase_rad double",
        )
        .withColumn("phase", positive_degrees("phase_rad"))
        .drop("phase_rad")
    )


def component_rows(components: DataFrame) -> DataFrame:
    """Components as named readings."""
    name = F.concat(F.lit("Wave Component "), F.col("component").cast("string"))
    cells = F.array(
        *[
            F.struct(F.concat(name, F.lit(f" {label}")).alias("name"), F.col(column).alias("measured"))
            for label, column in (("Frequency", "frequency"), ("Amplitude", "amplitude"), ("Phase", "phase"))
        ]
    )
    return components.select(*SERIES, "datetime", F.inline(cells))


def wave_windows(
    hf: DataFrame, step_minutes: int, components: int = TOP_COMPONENTS, start: str | None = None
) -> DataFrame:
    """Statistics and strongest components of every (start, end] window, in one long table."""
    windowed = in_windows(hf, step_minutes, start)
    waves = component_rows(wave_components(windowed, components, remove_mean=False))
    return hf_window_stats(windowed).unionByName(waves)


WINDOW_MINUTES = (1, 5, 10, 15)


def touched_windows(ranges: DataFrame, minutes: int, start: str | None = None) -> DataFrame:
    """(series, window_end) of every (end - minutes, end] window that the closed ranges of ``dirty_hf_ranges`` reach into."""
    first, last = (_window_end(c, minutes, start) for c in ("start_datetime", "end_datetime"))
    ends = F.sequence(first, last, F.expr(f"interval {minutes} minutes"))
    return ranges.select(*SERIES, F.explode(ends).alias("window_end")).distinct()


def hf_refresh(
    hf: DataFrame,
    ranges: DataFrame,
    summaries: DataFrame,
    minutes: Sequence[int] = WINDOW_MINUTES,
    components: int = TOP_COMPONENTS,
    start: str | None = None,
) -> DataFrame:
    """Window summaries (minutes, and the columns of ``wave_windows``) after the ranges changed: only the windows they reach are computed."""
    fresh, stale = None, None
    for m in minutes:
        windows = touched_windows(ranges, m, start)
        windowed = lookup(in_windows(hf, m, start), windows, [*SERIES, "window_end"], "left_semi")
        waves = component_rows(wave_components(windowed, components, remove_mean=False))
        made = hf_window_stats(windowed).unionByName(waves).withColumn("minutes", F.lit(m))
        keys = windows.select(*SERIES, F.col("window_end").alias("datetime"), F.lit(m).alias("minutes"))
        fresh, stale = (made, keys) if fresh is None else (fresh.unionByName(made), stale.unionByName(keys))
    return summaries.join(stale, [*SERIES, "datetime", "minutes"], "left_anti").unionByName(fresh)


def neighbourhood_features(
    obs: DataFrame, neighbourhood: DataFrame, period_minutes: int, interval_minutes: int
) -> DataFrame:
    """Rolling sums side by side for the times at which every station of a group has one.

    A group row gathers the stations of one neighbourhood, a list fixed by the neighbourhood table.
    """
    sizes = neighbourhood.groupBy("name").agg(F.count_distinct("station_id").alias("_size"))
    members = neighbourhood.join(sizes, "name")
    return (
        rolling_accumulation(obs, period_minutes, interval_minutes)
        .join(members, "station_id")
        .groupBy("name", "variable_id", "datetime")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.first("_size").alias("_size"),
            (F.sum("acc") / F.count(F.lit(1))).alias("avg"),
            F.sort_array(F.collect_list(F.struct("station_id", "acc"))).alias("stations"),
        )
        .filter("_n = _size")
        .drop("_n", "_size")
    )


def apply_prediction_labels(
    obs: DataFrame, predictions: DataFrame, mapping: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Sets ``ml_flag`` from mapped predictions; predictions without a mapping come back as errors."""
    known = predictions.join(mapping, "prediction_result").select(*KEY, F.col("quality_flag_id").alias("_ml"))
    errors = predictions.join(mapping, "prediction_result", "left_anti")
    labelled = obs.join(known, KEY, "left").withColumn("ml_flag", F.coalesce("_ml", "ml_flag")).drop("_ml")
    return labelled, errors
