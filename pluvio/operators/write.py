"""Inserts, upserts, corrections and the keys they make stale.

Batches are small next to the stored table. Each function first finds the stored rows a batch
touches with a left semi join: with a broadcastable batch the stored table is only scanned, and the
remaining joins run between two batch-sized sides. Without a broadcast they are joins on the unique
key, which holds the time and therefore cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import MISSING, MISSING_CODE, hour_bucket, local_day, shift_seconds, to_local, to_utc, ts
from pluvio.functions.joins import lookup
from pluvio.schema import KEY, SERIES


def insert_ignore(target: DataFrame, batch: DataFrame) -> DataFrame:
    """Adds only rows whose key is new."""
    known = target.join(batch.select(*KEY), KEY, "left_semi").select(*KEY)
    return target.unionByName(batch.join(known, KEY, "left_anti"), allowMissingColumns=True)


def _replace(target: DataFrame, batch: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Target with ``values`` (over batch columns ``n_*``) on matching keys, plus the new batch rows."""
    renamed = batch.select(*KEY, *[F.col(c).alias(f"n_{c}") for c in batch.columns if c not in KEY]).withColumn(
        "_hit", F.lit(True)
    )
    joined = target.join(renamed, KEY, "left")
    updated = joined.select(
        *[
            F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in target.columns
        ]
    )
    known = target.join(batch.select(*KEY), KEY, "left_semi").select(*KEY)
    return updated.unionByName(batch.join(known, KEY, "left_anti"), allowMissingColumns=True)


def upsert_override(target: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch replaces rows of the same key; manual flag and correction are cleared, the creation
    time stays."""
    kept = {"created_at", *KEY}
    cleared = {"manual_flag", "consisted"}
    values = {
        c: F.lit(None) if c in cleared else F.col(f"n_{c}")
        for c in target.columns
        if c not in kept and (c in cleared or c in batch.columns)
    }
    fresh = batch.withColumns({c: F.lit(None).cast(target.schema[c].dataType) for c in cleared if c in target.columns})
    return _replace(target, fresh, values)


def upsert_measured(target: DataFrame, batch: DataFrame) -> DataFrame:
    """High-frequency rule: only the measured value is replaced."""
    return _replace(target, batch.select(*KEY, "measured"), {"measured": F.col("n_measured")})


def latest_value_upsert(latest: DataFrame, batch: DataFrame, with_code: bool = False) -> DataFrame:
    """The batch's newest row replaces a stored one that is not newer."""
    code = F.col("code") if with_code else F.lit(None).cast("string")
    newest = (
        batch.withColumn("_code", code)
        .groupBy(*SERIES)
        .agg(F.max("datetime").alias("n_datetime"), *[F.max_by(c, "datetime").alias(f"n_{c}") for c in ("measured", "_code")])
    )
    stored = F.col("last_data_datetime")
    take = F.col("n_datetime").isNotNull() & (stored.isNull() | (F.col("n_datetime") >= stored))

    def pick(new: str, old: str) -> Column:
        return F.when(take, F.col(f"n_{new}")).otherwise(F.col(old)).alias(old)

    return latest.join(newest, SERIES, "full_outer").select(
        *SERIES,
        pick("datetime", "last_data_datetime"),
        pick("measured", "last_data_value"),
        pick("_code", "last_data_code"),
    )


def dirty_hours(batch: DataFrame) -> DataFrame:
    return (
        batch.filter("NOT is_daily")
        .select("station_id", F.date_trunc("hour", "datetime").alias("datetime"))
        .distinct()
    )


def _offsets(station: DataFrame) -> DataFrame:
    return station.select(F.col("id").alias("station_id"), "utc_offset_minutes")


def dirty_days(batch: DataFrame, station: DataFrame) -> DataFrame:
    """Local dates of the touched hours; hours are made distinct before the station is joined."""
    return (
        dirty_hours(batch)
        .join(_offsets(station), "station_id")
        .select("station_id", F.to_date(to_local("datetime")).alias("date"))
        .distinct()
    )


def touched_hour_buckets(batch: DataFrame) -> DataFrame:
    """Summary hours a batch changes: as ``dirty_hours`` but for right-closed and daily buckets."""
    bucket = F.when(F.col("is_daily"), F.date_trunc("hour", "datetime")).otherwise(hour_bucket())
    return batch.select("station_id", bucket.alias("datetime"), "is_daily").distinct()


def touched_day_buckets(batch: DataFrame, station: DataFrame) -> DataFrame:
    return (
        batch.select("station_id", "datetime", "is_daily")
        .join(_offsets(station), "station_id")
        .select("station_id", local_day().alias("day"), "is_daily")
        .distinct()
    )


def dirty_hf_ranges(batch: DataFrame) -> DataFrame:
    return batch.groupBy(*SERIES).agg(
        F.min("datetime").alias("start_datetime"), F.max("datetime").alias("end_datetime")
    )


def recompute_hours(obs: DataFrame, keys: DataFrame, summary: DataFrame) -> DataFrame:
    """Replaces the summary rows of the given (station, hour, is_daily) buckets."""
    from pluvio.operators.summary import hourly_summary

    on = ["station_id", "datetime", "is_daily"]
    bucket = F.when(F.col("is_daily"), F.date_trunc("hour", "datetime")).otherwise(hour_bucket())
    wanted = keys.select("station_id", F.col("datetime").alias("_bucket"), "is_daily")
    touched = obs.withColumn("_bucket", bucket).join(wanted, ["station_id", "_bucket", "is_daily"], "left_semi")
    fresh = hourly_summary(touched.drop("_bucket"))
    return summary.join(keys, on, "left_anti").unionByName(fresh)


def recompute_days(obs: DataFrame, station: DataFrame, keys: DataFrame, summary: DataFrame) -> DataFrame:
    """Replaces the summary rows of the given (station, local day, is_daily) buckets."""
    from pluvio.operators.summary import daily_summary

    on = ["station_id", "day", "is_daily"]
    bucketed = obs.join(_offsets(station), "station_id").withColumn("day", local_day())
    touched = bucketed.join(keys, on, "left_semi").select(*obs.columns)
    return summary.join(keys, on, "left_anti").unionByName(daily_summary(touched, station))


def register_station_variables(batch: DataFrame, station_variable: DataFrame) -> DataFrame:
    return batch.select(*SERIES).distinct().join(station_variable.select(*SERIES), SERIES, "left_anti")


def apply_manual_corrections(obs: DataFrame, patches: DataFrame) -> DataFrame:
    """Sets the supplied fields by key; ``has_<field>`` tells what a patch supplies."""
    fields = ["manual_flag", "consisted", "remarks"]
    side = patches.select(*KEY, *[F.col(f).alias(f"n_{f}") for f in fields], *[f"has_{f}" for f in fields])
    joined = obs.join(side, KEY, "left")
    return joined.select(
        *[
            F.when(F.col(f"has_{c}"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
            for c in obs.columns
        ]
    )


def correction_keys(patches: DataFrame, station: DataFrame) -> DataFrame:
    """Hour and local date each correction makes stale."""
    return (
        patches.select("station_id", "datetime")
        .join(_offsets(station), "station_id")
        .select(
            "station_id",
            F.date_trunc("hour", "datetime").alias("datetime"),
            F.to_date(to_local("datetime")).alias("date"),
        )
        .distinct()
    )


def apply_form_patch(obs: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blank value: delete; number: insert or set the measurement; other text: reported as error."""
    blank = F.coalesce(F.col("value"), F.lit("")) == ""
    number = F.col("value").try_cast("double")
    deletes = patches.filter(blank).select(*KEY)
    sets = patches.filter(~blank & number.isNotNull()).select(*KEY, number.alias("measured"))
    errors = patches.filter(~blank & number.isNull()).select(*KEY, "value")
    kept = obs.join(deletes, KEY, "left_anti")
    defaults = {"is_daily": F.lit(False)} if "is_daily" in obs.columns else {}
    changed = _replace(kept, sets.withColumns(defaults), {"measured": F.col("n_measured")})
    return changed, errors


def delete_and_refresh_latest(
    obs: DataFrame, deletes: DataFrame, latest: DataFrame, station: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deletes rows by key; where a deleted time was the newest of the named series of its station,
    those series show their newest remaining row. Also returns the stale (station, hour, date) keys."""
    remaining = obs.join(deletes.select(*KEY), KEY, "left_anti")
    named = deletes.select(*KEY).distinct()
    newest = (
        named.join(latest.select(*SERIES, "last_data_datetime"), SERIES)
        .groupBy("station_id", "datetime")
        .agg(F.max("last_data_datetime").alias("_newest"))
        .filter(F.col("_newest") == F.col("datetime"))
        .select("station_id", "datetime")
    )
    stale = named.join(newest, ["station_id", "datetime"], "left_semi").select(*SERIES).distinct()
    fresh = (
        lookup(remaining, stale, SERIES, "left_semi")
        .groupBy(*SERIES)
        .agg(F.max_by(F.struct("datetime", "measured", "code"), "datetime").alias("_n"))
    )
    hit = F.col("_n").isNotNull()
    refreshed = latest.join(fresh, SERIES, "left").select(
        *SERIES,
        F.when(hit, F.col("_n.datetime")).otherwise(F.col("last_data_datetime")).alias("last_data_datetime"),
        F.when(hit, F.col("_n.measured")).otherwise(F.col("last_data_value")).alias("last_data_value"),
        F.when(hit, F.col("_n.code")).otherwise(F.col("last_data_code")).alias("last_data_code"),
    )
    return remaining, refreshed, correction_keys(deletes, station)


def melt_hourly_capture(grid: DataFrame, station: DataFrame, as_of: str, hours_ahead: int = 1) -> DataFrame:
    """Hourly entry sheet ``(station_id, day, hour, values map, remarks, observer)`` to readings.

    Text that is no number becomes -99.9 with code ``/``; hours beyond ``as_of`` plus the allowance
    are left out.
    """
    local = F.timestamp_seconds(F.unix_seconds(F.col("day").cast("timestamp")) + F.col("hour") * 3600)
    number = F.col("text").try_cast("double")
    return (
        grid.join(_offsets(station), "station_id")
        .withColumn("_local", local)
        .withColumn("datetime", to_utc("_local"))
        .filter(F.col("datetime") <= shift_seconds(ts(as_of), hours_ahead * 3600))
        .select("station_id", "datetime", "remarks", "observer", F.explode("values").alias("variable_id", "text"))
        .select(
            "station_id",
            "variable_id",
            F.lit(3600).alias("seconds"),
            "datetime",
            F.coalesce(number, F.lit(MISSING)).alias("measured"),
            F.lit(1).alias("quality_flag"),
            F.lit(False).alias("is_daily"),
            "remarks",
            "observer",
            F.when(number.isNull(), MISSING_CODE).otherwise(F.col("text")).alias("code"),
        )
    )


def melt_monthly_capture(grid: DataFrame, station: DataFrame, as_of: str, is_daily: bool = False) -> DataFrame:
    """Monthly entry sheet ``(station_id, day, values map)`` to readings at local midnight."""
    return (
        grid.join(_offsets(station), "station_id")
        .withColumn("_local", F.col("day").cast("timestamp"))
        .withColumn("datetime", to_utc("_local"))
        .filter(F.col("datetime") <= ts(as_of))
        .select("station_id", "datetime", F.explode("values").alias("variable_id", "value"))
        .select(
            "station_id",
            "variable_id",
            F.lit(86400).alias("seconds"),
            "datetime",
            F.coalesce("value", F.lit(MISSING)).alias("measured"),
            F.lit(1).alias("quality_flag"),
            F.lit(is_daily).alias("is_daily"),
        )
    )
