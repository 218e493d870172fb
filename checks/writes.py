"""Inserts, upserts, corrections, dirty keys."""

from pyspark.sql import functions as F

from checks.base import AGG, VALID
from checks.registry import register
from checks.summaries import ASOF, latest
from checks.retrieval import LATEST
from pluvio.operators import summary, write

ON = "b.station_id = t.station_id AND b.variable_id = t.variable_id AND b.datetime = t.datetime"
KEY = "station_id, variable_id, datetime"


def target(t):
    """Everything read before the 20th."""
    return t.obs().filter(F.col("datetime") < F.lit("2024-01-20").cast("timestamp")).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp")
    )


def batch(t):
    """A later file that overlaps the stored readings."""
    return (
        t.obs()
        .filter(F.col("datetime") >= F.lit("2024-01-15").cast("timestamp"))
        .withColumn("measured", F.col("measured") + 0.5)
        .withColumn("created_at", F.lit("2024-02-01").cast("timestamp"))
    )


TARGET = "SELECT *, TIMESTAMP '2024-01-01' AS created_at FROM obs WHERE datetime < TIMESTAMP '2024-01-20'"
BATCH = "SELECT * REPLACE (measured + 0.5 AS measured), TIMESTAMP '2024-02-01' AS created_at FROM obs WHERE datetime >= TIMESTAMP '2024-01-15'"
MERGED = f"""SELECT t.* FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM bat b WHERE {ON})
  UNION ALL BY NAME SELECT b.* REPLACE (NULL AS manual_flag, NULL AS consisted, coalesce(t.created_at, b.created_at) AS created_at)
  FROM bat b LEFT JOIN tgt t ON {ON}"""
W = dict(tgt=TARGET, bat=BATCH, merged=MERGED)

register(
    "insert_ignore",
    lambda t: write.insert_ignore(target(t), batch(t)),
    f"SELECT * FROM tgt UNION ALL BY NAME SELECT * FROM bat b WHERE NOT EXISTS (SELECT 1 FROM tgt t WHERE {ON})",
    **W,
)
register("upsert_override", lambda t: write.upsert_override(target(t), batch(t)), "SELECT * FROM merged", **W)
register(
    "upsert_measured",
    lambda t: write.upsert_measured(
        target(t).select("station_id", "variable_id", "datetime", "measured"), batch(t)
    ),
    f"""SELECT {KEY}, measured FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM bat b WHERE {ON})
    UNION ALL SELECT {KEY}, measured FROM bat""",
    **W,
)


def staggered(t):
    return t.obs().filter(
        F.col("datetime") < F.timestamp_seconds(F.lit(1705017600) + F.col("station_id") % 20 * 86400)
    )


STAGGERED = """SELECT station_id, variable_id, datetime, measured, code FROM obs WHERE datetime < TIMESTAMP '2024-01-12' + to_days(station_id % 20)
  QUALIFY row_number() OVER (PARTITION BY station_id, variable_id ORDER BY datetime DESC) = 1"""


def stored_latest(t):
    from pluvio.operators.climatology import latest_by_rank

    return latest_by_rank(target(t)).withColumnsRenamed(
        {"datetime": "last_data_datetime", "measured": "last_data_value", "code": "last_data_code"}
    )


register(
    "latest_value_upsert",
    lambda t: write.latest_value_upsert(stored_latest(t), staggered(t), with_code=True),
        """SELECT station_id, variable_id, CASE WHEN take THEN nd ELSE last_data_datetime END AS last_data_datetime,
      CASE WHEN take THEN nm ELSE last_data_value END AS last_data_value, CASE WHEN take THEN nc ELSE last_data_code END AS last_data_code
    FROM (SELECT station_id, variable_id, n.datetime AS nd, n.measured AS nm, n.code AS nc, last_data_datetime, last_data_value, last_data_code,
        n.datetime IS NOT NULL AND (last_data_datetime IS NULL OR n.datetime >= last_data_datetime) AS take
      FROM sl FULL JOIN staggered n USING (station_id, variable_id))""",
    sl=LATEST.replace("FROM obs", "FROM tgt"),
    staggered=STAGGERED,
    **W,
)
register(
    "dirty_hours",
    lambda t: write.dirty_hours(batch(t)),
    "SELECT DISTINCT station_id, date_trunc('hour', datetime) AS datetime FROM bat WHERE NOT is_daily",
    **W,
)
register(
    "dirty_days",
    lambda t: write.dirty_days(batch(t), t.station()),
    """SELECT DISTINCT station_id, CAST(date_trunc('hour', datetime) + to_minutes(s.utc_offset_minutes) AS DATE) AS date
    FROM bat JOIN station s ON s.id = station_id WHERE NOT is_daily""",
    **W,
)
register(
    "dirty_hf_ranges",
    lambda t: write.dirty_hf_ranges(t.hf()),
    "SELECT station_id, variable_id, min(datetime) AS start_datetime, max(datetime) AS end_datetime FROM hf GROUP BY 1, 2",
)
MCALC = "SELECT *, coalesce(consisted, measured) AS v FROM merged"
register(
    "recompute_dirty_summaries",
    lambda t: write.recompute_hours(
        write.upsert_override(target(t), batch(t)),
        write.touched_hour_buckets(batch(t)),
        summary.hourly_summary(target(t)),
    ),
    f"""SELECT CASE WHEN NOT is_daily AND datetime = date_trunc('day', datetime)
        THEN date_trunc('hour', datetime - INTERVAL 1 SECOND) ELSE date_trunc('hour', datetime) END AS datetime,
      station_id, variable_id, is_daily, {AGG} FROM mcalc WHERE {VALID} GROUP BY 1, 2, 3, 4""",
    mcalc=MCALC,
    **W,
)
register(
    "recompute_dirty_days",
    lambda t: write.recompute_days(
        write.upsert_override(target(t), batch(t)),
        t.station(),
        write.touched_day_buckets(batch(t), t.station()),
        summary.daily_summary(target(t), t.station()),
    ),
    f"""SELECT CAST(datetime + to_minutes(utc_offset_minutes) - CASE WHEN is_daily THEN INTERVAL 0 SECOND ELSE INTERVAL 1 SECOND END AS DATE) AS day,
      station_id, variable_id, is_daily, {AGG} FROM mcalc JOIN station s ON s.id = station_id WHERE {VALID} GROUP BY 1, 2, 3, 4""",
    mcalc=MCALC,
    **W,
)
register(
    "register_station_variables",
    lambda t: write.register_station_variables(
        t.obs(), t.obs().filter(F.col("datetime") < F.lit("2024-01-03").cast("timestamp"))
    ),
    """SELECT DISTINCT station_id, variable_id FROM obs
    EXCEPT SELECT station_id, variable_id FROM obs WHERE datetime < TIMESTAMP '2024-01-03'""",
)


def patches(t):
    flag = F.col("quality_flag")
    return batch(t).select(
        "station_id",
        "variable_id",
        "datetime",
        F.lit(4).alias("manual_flag"),
        (F.col("measured") + 1).alias("consisted"),
        F.lit("checked").alias("remarks"),
        (flag == 3).alias("has_manual_flag"),
        flag.isin(2, 3).alias("has_consisted"),
        (F.col("variable_id") == 5).alias("has_remarks"),
    )


register(
    "apply_manual_corrections",
    lambda t: write.apply_manual_corrections(t.obs(), patches(t)),
    f"""SELECT t.* REPLACE (CASE WHEN b.quality_flag = 3 THEN 4 ELSE t.manual_flag END AS manual_flag,
      CASE WHEN b.quality_flag IN (2, 3) THEN b.measured + 1 ELSE t.consisted END AS consisted,
      CASE WHEN b.variable_id = 5 THEN 'checked' ELSE t.remarks END AS remarks) FROM obs t LEFT JOIN bat b ON {ON}""",
    **W,
)
register(
    "correction_keys",
    lambda t: write.correction_keys(patches(t), t.station()),
    """SELECT DISTINCT station_id, date_trunc('hour', datetime) AS datetime, CAST(datetime + to_minutes(s.utc_offset_minutes) AS DATE) AS date
    FROM bat JOIN station s ON s.id = station_id""",
    **W,
)


def form_patches(t):
    flag = F.col("quality_flag")
    return batch(t).select(
        "station_id",
        "variable_id",
        F.when(F.col("variable_id") == 2, F.timestamp_seconds(F.unix_seconds("datetime") + 30))
        .otherwise(F.col("datetime"))
        .alias("datetime"),
        F.when(flag == 1, "").when(flag == 2, "abc").otherwise(F.col("measured").cast("string")).alias("value"),
    )


FORM = """SELECT station_id, variable_id, CASE WHEN variable_id = 2 THEN datetime + INTERVAL 30 SECOND ELSE datetime END AS datetime,
  CASE quality_flag WHEN 1 THEN '' WHEN 2 THEN 'abc' ELSE CAST(measured AS VARCHAR) END AS value, measured FROM bat"""
register(
    "apply_form_patch",
    lambda t: write.apply_form_patch(t.obs().select("station_id", "variable_id", "datetime", "measured", "is_daily"), form_patches(t))[0],
    f"""SELECT t.station_id, t.variable_id, t.datetime, coalesce(TRY_CAST(b.value AS DOUBLE), t.measured) AS measured, t.is_daily
      FROM obs t LEFT JOIN form b ON {ON} WHERE b.value IS NULL OR b.value <> ''
    UNION ALL SELECT {KEY}, measured, false FROM form b WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM obs t WHERE {ON})""",
    form=FORM,
    **W,
)
register(
    "apply_form_patch_errors",
    lambda t: write.apply_form_patch(t.obs(), form_patches(t))[1],
    f"SELECT {KEY}, value FROM form WHERE value = 'abc'",
    form=FORM,
    **W,
)


def deletes(t):
    ends = t.obs().groupBy("station_id", "variable_id").agg(
        F.max("datetime").alias("a"), F.min("datetime").alias("b")
    )
    return ends.select("station_id", "variable_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("datetime"))


DELETES = """SELECT station_id, variable_id, max(datetime) AS datetime FROM obs GROUP BY 1, 2
  UNION SELECT station_id, variable_id, min(datetime) FROM obs GROUP BY 1, 2"""
LEFTOVER = f"SELECT * FROM obs t WHERE NOT EXISTS (SELECT 1 FROM dels b WHERE {ON})"


def deleted(t, part):
    return write.delete_and_refresh_latest(t.obs(), deletes(t), latest(t), t.station())[part]


register("delete_and_refresh_latest", lambda t: deleted(t, 1),
    """SELECT l.station_id, l.variable_id, coalesce(r.last_data_datetime, l.last_data_datetime) AS last_data_datetime,
      CASE WHEN r.station_id IS NULL THEN l.last_data_value ELSE r.last_data_value END AS last_data_value,
      CASE WHEN r.station_id IS NULL THEN l.last_data_code ELSE r.last_data_code END AS last_data_code
    FROM lastrow l LEFT JOIN remaining r USING (station_id, variable_id)""",
    dels=DELETES, leftover=LEFTOVER, lastrow=LATEST, remaining=LATEST.replace("FROM obs", "FROM leftover"))
register("delete_rows", lambda t: deleted(t, 0), "SELECT * FROM leftover", dels=DELETES, leftover=LEFTOVER)
register(
    "delete_keys",
    lambda t: deleted(t, 2),
    """SELECT DISTINCT station_id, date_trunc('hour', datetime) AS datetime, CAST(datetime + to_minutes(s.utc_offset_minutes) AS DATE) AS date
    FROM dels JOIN station s ON s.id = station_id""",
    dels=DELETES,
)


def hourly_grid(t):
    s = t.station().select(F.col("id").alias("station_id"), "utc_offset_minutes")
    local = F.timestamp_seconds(F.unix_seconds("datetime") + F.col("utc_offset_minutes") * 60)
    text = F.when(F.col("variable_id") == 5, F.col("code")).otherwise(
        F.when(F.col("measured") != -99.9, F.col("measured").cast("string"))
    )
    cells = (
        t.obs()
        .join(s, "station_id")
        .groupBy("station_id", F.to_date(local).alias("day"), F.hour(local).alias("hour"), "variable_id")
        .agg(F.max(text).alias("text"), F.max("remarks").alias("r"), F.max("observer").alias("o"))
    )
    # at most one entry per variable
    return cells.groupBy("station_id", "day", "hour").agg(
        F.map_from_entries(F.collect_list(F.struct("variable_id", "text"))).alias("values"),
        F.max("r").alias("remarks"),
        F.max("o").alias("observer"),
    )


register(
    "melt_hourly_capture",
    lambda t: write.melt_hourly_capture(hourly_grid(t), t.station(), ASOF),
    """SELECT c.station_id, variable_id, 3600 AS seconds, d AS datetime, coalesce(TRY_CAST(text AS DOUBLE), -99.9) AS measured, 1 AS quality_flag,
      false AS is_daily, g.remarks, g.observer, CASE WHEN TRY_CAST(text AS DOUBLE) IS NULL THEN '/' ELSE text END AS code
    FROM (SELECT station_id, date_trunc('hour', datetime) AS d, variable_id,
        max(CASE WHEN variable_id = 5 THEN code WHEN measured <> -99.9 THEN CAST(measured AS VARCHAR) END) AS text FROM obs GROUP BY 1, 2, 3) c
      JOIN (SELECT station_id, date_trunc('hour', datetime) AS d, max(remarks) AS remarks, max(observer) AS observer FROM obs GROUP BY 1, 2) g
        USING (station_id, d)
    WHERE d <= TIMESTAMP '2024-01-15 13:00:00'""",
)


def monthly_grid(t):
    s = t.station().select(F.col("id").alias("station_id"), "utc_offset_minutes")
    local = F.timestamp_seconds(F.unix_seconds("datetime") + F.col("utc_offset_minutes") * 60)
    cells = (
        t.obs()
        .join(s, "station_id")
        .groupBy("station_id", F.to_date(local).alias("day"), "variable_id")
        .agg(F.max(F.when(F.col("measured") != -99.9, F.col("measured"))).alias("value"))
    )
    return cells.groupBy("station_id", "day").agg(
        F.map_from_entries(F.collect_list(F.struct("variable_id", "value"))).alias("values")
    )


register(
    "melt_monthly_capture",
    lambda t: write.melt_monthly_capture(monthly_grid(t), t.station(), ASOF),
    """SELECT station_id, variable_id, 86400 AS seconds, CAST(day AS TIMESTAMP) - to_minutes(utc_offset_minutes) AS datetime,
      coalesce(value, -99.9) AS measured, 1 AS quality_flag, false AS is_daily
    FROM (SELECT station_id, s.utc_offset_minutes, CAST(datetime + to_minutes(s.utc_offset_minutes) AS DATE) AS day, variable_id,
        max(measured) FILTER (measured <> -99.9) AS value FROM obs JOIN station s ON s.id = station_id GROUP BY 1, 2, 3, 4)
    WHERE CAST(day AS TIMESTAMP) - to_minutes(utc_offset_minutes) <= TIMESTAMP '2024-01-15 12:00:00'""",
)
