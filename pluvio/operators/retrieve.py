"""Lists, reports, maps and forms: filters, projections and joins with the dimensions.

Dimensions are joined without a hint: Catalyst broadcasts them when their measured size allows it and
otherwise falls back to a sort-merge join whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.columns import (
    DAY_SECONDS,
    is_coded,
    not_missing,
    pick_current_day,
    pick_last24,
    pick_listing,
    pick_report,
    round_half_even,
    shift_seconds,
    slug,
    to_local,
    ts,
)
from pluvio.functions.joins import lookup
from pluvio.schema import KEY, SERIES

# Longest span in days that an interactive report may ask for, by source.
REPORT_SPAN_DAYS = {"raw": 7, "hourly": 30, "daily": 365}
TIME_COLUMN = {"raw": "datetime", "hourly": "datetime", "daily": "day", "monthly": "date", "yearly": "date"}


def _variables(variable: DataFrame) -> DataFrame:
    return variable.select(
        F.col("id").alias("variable_id"),
        F.col("symbol").alias("variable_symbol"),
        F.col("name").alias("variable_name"),
        "variable_type",
        "sampling_operation_id",
        "unit_id",
        "measurement_variable_id",
        "color",
    )


def _units(unit: DataFrame) -> DataFrame:
    return unit.select(
        F.col("id").alias("unit_id"), F.col("name").alias("unit_name"), F.col("symbol").alias("unit_symbol")
    )


def select_keys(
    df: DataFrame,
    stations: Sequence[int] | None = None,
    variables: Sequence[int] | None = None,
    start: str | None = None,
    end: str | None = None,
    time_column: str = "datetime",
) -> DataFrame:
    """Closed time range and key filters on the stored columns, so they reach the scan."""
    if stations is not None:
        df = df.filter(F.col("station_id").isin(list(stations)))
    if variables is not None:
        df = df.filter(F.col("variable_id").isin(list(variables)))
    literal = (lambda text: F.lit(text).cast("date")) if time_column in ("day", "date") else ts
    if start is not None:
        df = df.filter(F.col(time_column) >= literal(start))
    if end is not None:
        df = df.filter(F.col(time_column) <= literal(end))
    return df


def raw_list(obs: DataFrame, variable: DataFrame, unit: DataFrame, flag: DataFrame, **keys) -> DataFrame:
    """Readings with variable, unit and flag; coded variables show their code, others a number."""
    symbols = flag.select(F.col("id").alias("quality_flag"), F.col("symbol").alias("flag_symbol"))
    coded = is_coded()
    return (
        select_keys(obs, **keys)
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id", "left")
        .join(symbols, "quality_flag")
        .select(
            *KEY,
            F.when(~coded, round_half_even("measured", 2)).alias("value"),
            F.when(coded, F.col("code")).alias("code"),
            "variable_symbol",
            "variable_name",
            "unit_name",
            "unit_symbol",
            "flag_symbol",
        )
        .orderBy(*KEY)
    )


def summary_list(
    summary: DataFrame, variable: DataFrame, unit: DataFrame, source: str, **keys
) -> DataFrame:
    """Summary rows with the figure that suits the variable's sampling operation."""
    at = TIME_COLUMN[source]
    return (
        select_keys(summary, time_column=at, **keys)
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id")
        .withColumn("value", round_half_even(pick_listing(), 2))
        .filter("value IS NOT NULL")
        .select(
            at,
            *SERIES,
            "value",
            *[round_half_even(f"{c}_value", 2).alias(c) for c in ("min", "max", "avg", "sum")],
            F.col("num_records").alias("count"),
            "variable_symbol",
            "variable_name",
            "unit_name",
            "unit_symbol",
        )
        .orderBy(at, *SERIES)
    )


def last24_list(last24: DataFrame, variable: DataFrame, unit: DataFrame, **keys) -> DataFrame:
    return (
        select_keys(last24, **keys)
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id")
        .select(
            *SERIES,
            pick_last24().alias("value"),
            *[round_half_even(f"{c}_value", 2).alias(c) for c in ("min", "max", "avg", "sum")],
            F.col("num_records").alias("count"),
            "variable_symbol",
            "variable_name",
            "unit_name",
            "unit_symbol",
        )
    )


def _newest_of_station(latest: DataFrame) -> DataFrame:
    """Rows as new as the station's newest one that has a value.

    The per-station maximum is one small row per station, joined back instead of re-read per row.
    """
    valued = latest.filter("last_data_value IS NOT NULL")
    newest = valued.groupBy("station_id").agg(F.max("last_data_datetime").alias("_newest"))
    return valued.join(newest, "station_id").filter(F.col("last_data_datetime") == F.col("_newest")).drop("_newest")


def _shown_value() -> Column:
    return F.when(is_coded(), F.col("last_data_code")).otherwise(F.col("last_data_value").cast("string"))


def latest_for_station(latest: DataFrame, variable: DataFrame, unit: DataFrame) -> DataFrame:
    return (
        _newest_of_station(latest)
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id", "left")
        .select(
            *SERIES,
            _shown_value().alias("value"),
            "last_data_datetime",
            "variable_name",
            "variable_symbol",
            "unit_name",
            "unit_symbol",
        )
    )


def latest_for_variable_map(
    latest: DataFrame, variable: DataFrame, unit: DataFrame, station: DataFrame, variable_id: int | None = None
) -> DataFrame:
    rows = _newest_of_station(latest)
    if variable_id is not None:
        rows = rows.filter(F.col("variable_id") == variable_id)
    places = station.select(F.col("id").alias("station_id"), "longitude", "latitude")
    return (
        rows.join(_variables(variable), "variable_id")
        .join(places, "station_id")
        .join(_units(unit), "unit_id", "left")
        .select(*SERIES, _shown_value().alias("value"), "longitude", "latitude", "unit_symbol")
    )


def current_day(daily: DataFrame, variable: DataFrame, unit: DataFrame, local_date: dt.date) -> DataFrame:
    return (
        daily.filter(F.col("day") == F.lit(local_date))
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id")
        .select(
            "day", *SERIES, pick_current_day().alias("value"), "variable_name", "variable_symbol", "unit_name", "unit_symbol"
        )
    )


def livedata_bundle(past24: DataFrame, newest: DataFrame, today: DataFrame) -> DataFrame:
    """The three live sections of a station in one table."""
    columns = ["variable_name", "variable_symbol", "unit_name", "unit_symbol"]

    def part(df: DataFrame, section: str) -> DataFrame:
        return df.select(F.lit(section).alias("section"), *SERIES, F.col("value").cast("string").alias("value"), *columns)

    return part(past24, "past24h").unionByName(part(newest, "latest")).unionByName(part(today, "current_day"))


def raw_last_24h_local(
    obs: DataFrame, station: DataFrame, variable: DataFrame, unit: DataFrame, as_of: str
) -> DataFrame:
    """Last day's readings grouped by local time; one row holds one station's variables at one time."""
    offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
    return (
        obs.filter(F.col("datetime") >= shift_seconds(ts(as_of), -DAY_SECONDS))
        .filter(not_missing("measured"))
        .join(offsets, "station_id")
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id", "left")
        .withColumn("local_datetime", F.date_format(to_local("datetime"), "yyyy-MM-dd HH:mm:ss"))
        .groupBy("station_id", "local_datetime")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("variable_name", "variable_symbol", "unit_name", "unit_symbol", "measured"))
            ).alias("readings")
        )
    )


def form_grid_12h(obs: DataFrame, pairs: DataFrame, month: dt.date) -> DataFrame:
    """Month sheet with the 06 and 18 h readings of every day."""
    first, after = _month_bounds(month)
    values = (
        obs.filter(
            (F.col("datetime") >= ts(f"{first} 00:00:00")) & (F.col("datetime") < ts(f"{after} 00:00:00"))
        )
        .filter(_is_form_time("datetime"))
        .groupBy(*SERIES, F.to_date("datetime").alias("day"))
        .agg(
            F.max(F.when(F.hour("datetime") == 6, F.col("measured"))).alias("value_06am"),
            F.max(F.when(F.hour("datetime") == 18, F.col("measured"))).alias("value_06pm"),
        )
    )
    grid = pairs.select(*SERIES).withColumn(
        "day", F.explode(F.sequence(F.lit(first), F.lit(after - dt.timedelta(days=1))))
    )
    return grid.join(values, [*SERIES, "day"], "left")


def _is_form_time(c: str) -> Column:
    return (F.col(c) == F.date_trunc("hour", c)) & F.hour(c).isin(6, 18)


def _month_bounds(month: dt.date) -> tuple[dt.date, dt.date]:
    first = month.replace(day=1)
    return first, (first + dt.timedelta(days=32)).replace(day=1)


def _local_rows(obs: DataFrame, station: DataFrame) -> DataFrame:
    offsets = station.select(F.col("id").alias("station_id"), "utc_offset_minutes")
    return obs.join(offsets, "station_id").withColumn("local_datetime", to_local("datetime"))


def capture_day_load(obs: DataFrame, variable: DataFrame, station: DataFrame, day: dt.date) -> DataFrame:
    """One local day of every station, half open, with the code or the number as text."""
    near = obs.filter(
        (F.col("datetime") >= ts(f"{day - dt.timedelta(days=1)} 00:00:00"))
        & (F.col("datetime") < ts(f"{day + dt.timedelta(days=2)} 00:00:00"))
    )
    return (
        _local_rows(near, station)
        .filter(F.to_date("local_datetime") == F.lit(day))
        .join(_variables(variable), "variable_id")
        .select(
            "local_datetime",
            *SERIES,
            F.when(is_coded(), F.col("code")).otherwise(F.col("measured").cast("string")).alias("value"),
            "remarks",
            "observer",
        )
    )


def capture_month_load(obs: DataFrame, station: DataFrame, month: dt.date) -> DataFrame:
    """Readings from the first to the last day of a month (closed, UTC) at local time."""
    first, after = _month_bounds(month)
    last = after - dt.timedelta(days=1)
    rows = obs.filter(
        (F.col("datetime") >= ts(f"{first} 00:00:00")) & (F.col("datetime") <= ts(f"{last} 00:00:00"))
    )
    return _local_rows(rows, station).select("local_datetime", *SERIES, "measured")


def check_span(source: str, start: str, end: str) -> None:
    """Refuses spans too long for an interactive report; no operator here calls it."""
    first, last = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
    if first > last:
        raise ValueError("the start must not be after the end")
    limit = REPORT_SPAN_DAYS.get(source)
    if limit is not None and last - first > dt.timedelta(days=limit):
        raise ValueError(f"{source} reports cover at most {limit} days")


def _report(rows: DataFrame, source: str, flag: DataFrame | None) -> DataFrame:
    at = TIME_COLUMN[source]
    if source == "raw":
        names = flag.select(
            F.col("id").alias("quality_flag"), F.col("name").alias("flag_name"), F.col("color").alias("flag_color")
        )
        rows = rows.join(names, "quality_flag")
        value = F.col("measured")
    else:
        rows = rows.withColumns({"flag_name": F.lit(None).cast("string"), "flag_color": F.lit(None).cast("string")})
        value = pick_report()
    return rows.withColumn("epoch_ms", F.unix_millis(F.col(at).cast("timestamp"))).withColumn(
        "value", round_half_even(value, 2)
    )


REPORT_COLUMNS = [
    "measurement_variable",
    "variable_symbol",
    "station_id",
    "epoch_ms",
    "value",
    "unit_symbol",
    "color",
    "flag_name",
    "flag_color",
]


def report_series(
    rows: DataFrame,
    source: str,
    variable: DataFrame,
    unit: DataFrame,
    measurement_variable: DataFrame,
    flag: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    stations: Sequence[int] | None = None,
    variables: Sequence[int] | None = None,
) -> DataFrame:
    """Chart points of any source and any span; an interactive caller may ask ``check_span`` first."""
    mv = measurement_variable.select(
        F.col("id").alias("measurement_variable_id"), F.col("name").alias("measurement_variable")
    )
    joined = (
        select_keys(rows, stations, variables, start, end, TIME_COLUMN[source])
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id")
        .join(mv, "measurement_variable_id")
    )
    return _report(joined, source, flag).select(*REPORT_COLUMNS)


def compare_stations(
    rows: DataFrame,
    source: str,
    station_variable: DataFrame,
    station: DataFrame,
    variable: DataFrame,
    unit: DataFrame,
    flag: DataFrame | None = None,
    start: str | None = None,
    end: str | None = None,
    stations: Sequence[int] | None = None,
    variables: Sequence[int] | None = None,
) -> DataFrame:
    """Several variables of several stations side by side, registered pairs only."""
    names = station.select(F.col("id").alias("station_id"), F.col("name").alias("station_name"))
    joined = (
        select_keys(rows, stations, variables, start, end, TIME_COLUMN[source])
        .join(station_variable.select(*SERIES), SERIES, "left_semi")
        .join(_variables(variable), "variable_id")
        .join(_units(unit), "unit_id")
        .join(names, "station_id")
    )
    return _report(joined, source, flag).select(
        "station_name", "variable_name", "station_id", "epoch_ms", "value", "unit_symbol", "color", "flag_name", "flag_color"
    )


def _points(
    rows: DataFrame, source: str, station: DataFrame, variable: DataFrame, quality_flags: Sequence[int] | None
) -> DataFrame:
    at = TIME_COLUMN[source]
    places = station.select(F.col("id").alias("station_id"), "name", "code", "latitude", "longitude")
    if source == "raw":
        rows = rows.filter(not_missing("measured"))
        if quality_flags:
            rows = rows.filter(F.col("quality_flag").isin(list(quality_flags)))
        valued = rows.select(at, *SERIES, F.col("measured").alias("value"))
    else:
        ops = variable.select(F.col("id").alias("variable_id"), "sampling_operation_id")
        valued = rows.join(ops, "variable_id").withColumn("value", pick_report())
    return valued.join(places, "station_id").select(
        at, *SERIES, "name", "code", "latitude", "longitude", F.col("value").alias("measured")
    )


def spatial_points_instant(
    rows: DataFrame,
    source: str,
    station: DataFrame,
    variable: DataFrame,
    at: str | None = None,
    variable_id: int | None = None,
    quality_flags: Sequence[int] | None = None,
) -> DataFrame:
    """Station values with coordinates at one time, or at every time when ``at`` is left out."""
    picked = select_keys(
        rows, None, None if variable_id is None else [variable_id], at, at, TIME_COLUMN[source]
    )
    return _points(picked, source, station, variable, quality_flags)


# Aggregates a user may name.
POINT_AGGREGATES = {
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "count": F.count,
    "median": None,
    "std": F.stddev_samp,
    "var": F.var_samp,
}


# Where the middle is looked for: shares of a group around its half, ten times the error the sketch promises.
SKETCH = 10_000
AROUND = (0.5 - 10 / SKETCH, 0.5 + 10 / SKETCH)


def exact_median(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``by`` and the exact median of ``value`` as ``median``; null for groups without values, NaN is the largest value.

    A sketch of bounded size names two values around the middle of each group. Rows below and above them are only
    counted; values between them are counted by value, and a running count over these, sorted and read as a
    stream, finds the one or two middle ones. No buffer holds a group, and a group of few distinct
    values leaves only these. Should the middle lie outside the two values, the job stops rather than give a wrong figure.
    """
    v = F.col(value)
    key = F.struct(*by)
    # the sketch can't order NaN, which takes the place of infinity there; both are then counted by value
    sketched = F.when(F.isnan(v), F.lit(float("inf"))).otherwise(v).alias("_sketched")
    keyed = rows.select(F.xxhash64(key).alias("_key"), *by, v.alias("_value"), sketched)
    cuts = keyed.groupBy("_key", *by).agg(
        F.count("_value").alias("_n"),
        F.percentile_approx("_sketched", list(AROUND), SKETCH).alias("_cut"),
    )
    pairs = cuts.select("_key", F.struct(*by).alias("_by"), "_n", "_cut")
    same = F.struct(*by).eqNullSafe(F.col("_by"))
    placed = lookup(
        keyed.filter(F.col("_value").isNotNull()), pairs, ["_key"], "inner", spread=["_value", *by], extra=same
    )
    # the cuts are values of the column itself, so they compare exactly
    part = F.when(F.col("_sketched") < F.col("_cut")[0], 0).when(F.col("_sketched") > F.col("_cut")[1], 2).otherwise(1)
    counted = (
        placed.withColumn("_part", part)
        .groupBy("_key", "_by", "_n", "_part", F.when(F.col("_part") == 1, F.col("_value")).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    order = Window.partitionBy("_key", "_by").orderBy("_part", "_value")
    upto = F.sum("_times").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # ranks of the lower and the upper middle, from 1
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1

    def holds(rank: Column) -> Column:
        return (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_times") < rank)

    found = F.when(F.col("_part") == 1, F.col("_value").cast("double")).otherwise(
        F.raise_error(F.lit("median outside the sketched range")).cast("double")
    )
    middle = (
        counted.withColumn("_upto", upto)
        .filter(holds(lower) | holds(upper))
        .withColumn("_found", found)
        .groupBy("_key", "_by")
        .agg(((F.min("_found") + F.max("_found")) / 2).alias("median"))
        .select(F.col("_key").alias("_mkey"), F.col("_by").alias("_mby"), "median")
    )
    return cuts.join(middle, (F.col("_key") == F.col("_mkey")) & F.struct(*by).eqNullSafe(F.col("_mby")), "left").select(
        *by, "median"
    )


def spatial_points_aggregated(
    rows: DataFrame,
    source: str,
    station: DataFrame,
    variable: DataFrame,
    agg: str,
    start: str | None = None,
    end: str | None = None,
    variable_id: int | None = None,
    quality_flags: Sequence[int] | None = None,
) -> DataFrame:
    if agg not in POINT_AGGREGATES:
        raise ValueError(f"unknown aggregate {agg}")
    picked = select_keys(
        rows, None, None if variable_id is None else [variable_id], start, end, TIME_COLUMN[source]
    )
    points = _points(picked, source, station, variable, quality_flags)
    by = [*SERIES, "name", "code", "longitude", "latitude"]
    if agg == "median":
        return exact_median(points, by, "measured").withColumnRenamed("median", "measured")
    return points.groupBy(*by).agg(POINT_AGGREGATES[agg]("measured").alias("measured"))


def spatial_points_summary(summary: DataFrame, source: str, station: DataFrame, at: str | None = None) -> DataFrame:
    places = station.select(F.col("id").alias("station_id"), "latitude", "longitude")
    column = TIME_COLUMN[source]
    return (
        select_keys(summary, start=at, end=at, time_column=column)
        .join(places, "station_id")
        .select(column, *SERIES, "latitude", "longitude", F.col("avg_value").alias("value"))
    )


def variable_labels(variable: DataFrame, unit: DataFrame) -> DataFrame:
    return _variables(variable).join(_units(unit), "unit_id", "left").select(
        "variable_id",
        F.when(
            F.col("unit_symbol").isNotNull(),
            F.concat("variable_symbol", F.lit(" - "), "variable_name", F.lit(" ("), "unit_symbol", F.lit(")")),
        )
        .otherwise(F.concat("variable_symbol", F.lit(" - "), "variable_name"))
        .alias("label"),
    )


def station_filter(
    station: DataFrame,
    region: str | None = None,
    watershed: str | None = None,
    profile_id: int | None = None,
    is_automatic: bool | None = None,
    is_active: bool | None = None,
    name_contains: str | None = None,
) -> DataFrame:
    wanted = {
        "region": region,
        "watershed": watershed,
        "profile_id": profile_id,
        "is_automatic": is_automatic,
        "is_active": is_active,
    }
    for column, value in wanted.items():
        if value is not None:
            station = station.filter(F.col(column) == F.lit(value))
    if name_contains is not None:
        station = station.filter(F.lower("name").contains(name_contains.lower()))
    return station


def stations_with_variable(
    station_variable: DataFrame, station: DataFrame, variable_ids: Sequence[int] | None = None
) -> DataFrame:
    pairs = station_variable
    if variable_ids is not None:
        pairs = pairs.filter(F.col("variable_id").isin(list(variable_ids)))
    pairs = pairs.select(F.col("station_id").alias("id"))
    return station.join(pairs, "id", "left_semi").select("id", "name", "code")


def station_variable_detail(
    latest: DataFrame,
    station_variable: DataFrame,
    variable: DataFrame,
    unit: DataFrame,
    measurement_variable: DataFrame,
) -> DataFrame:
    mv = measurement_variable.select(
        F.col("id").alias("measurement_variable_id"), F.col("name").alias("measurement_variable")
    )
    return (
        station_variable.select(*SERIES)
        .join(latest, SERIES, "left")
        .join(_variables(variable), "variable_id", "left")
        .join(_units(unit), "unit_id", "left")
        .join(mv, "measurement_variable_id", "left")
        .select(
            *SERIES,
            "variable_symbol",
            "variable_name",
            "color",
            "unit_symbol",
            "measurement_variable",
            slug("measurement_variable").alias("measurement_variable_slug"),
            "last_data_datetime",
            "last_data_value",
            "last_data_code",
        )
    )


def resolve_station_by_name(names: DataFrame, station: DataFrame) -> DataFrame:
    """Manual station for each sheet name: by name, else alias, else alternative name.

    A rule that finds several stations counts as finding none; names left over are errors.
    """
    manual = station.filter("NOT is_automatic")

    def unique(column: str, out: str) -> DataFrame:
        return (
            manual.filter(F.col(column).isNotNull())
            .groupBy(F.col(column).alias("sheet_name"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias(out))
            .filter("_n = 1")
            .drop("_n")
        )

    return (
        names.select("sheet_name")
        .join(unique("name", "_by_name"), "sheet_name", "left")
        .join(unique("alias_name", "_by_alias"), "sheet_name", "left")
        .join(unique("alternative_names", "_by_other"), "sheet_name", "left")
        .select("sheet_name", F.coalesce("_by_name", "_by_alias", "_by_other").alias("station_id"))
        .withColumn(
            "error",
            F.when(F.col("station_id").isNull(), F.concat(F.lit("Failed to find station by name "), "sheet_name")),
        )
    )
