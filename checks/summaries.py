"""Summaries, statistics, climatology, inventories, monitoring."""

import datetime as dt

from checks.base import AS_OF, r2, r2e, t2
from checks.registry import register
from pluvio.operators import climatology, inventory, monitor, stats, summary

ASOF = "2024-01-15 12:00:00"
D0, D1 = dt.date(2024, 1, 1), dt.date(2024, 1, 31)
WEEK_END = dt.date(2024, 1, 15)


def hourly(t):
    return summary.hourly_summary(t.obs())


def daily(t):
    return summary.daily_summary(t.obs(), t.station())


def completeness(t):
    return summary.completeness_daily(t.obs(), t.station_variable(), t.station(), D0, D1)


def latest(t):
    return climatology.latest_by_rank(t.obs()).withColumnsRenamed(
        {"datetime": "last_data_datetime", "measured": "last_data_value", "code": "last_data_code"}
    )


register("hourly_summary", hourly, "SELECT * FROM hourly")
register("daily_summary", daily, "SELECT * FROM daily")
register("last24h_summary", lambda t: summary.last24h_summary(t.obs(), ASOF), "SELECT * FROM last24")
register("monthly_summary", lambda t: summary.monthly_summary(t.climate_daily()), "SELECT * FROM monthly")
register("yearly_summary", lambda t: summary.yearly_summary(t.climate_daily()), "SELECT * FROM yearly")
register(
    "period_summary_unweighted",
    lambda t: summary.period_summary_unweighted(t.climate_daily(), t.variable(), t.unit(), t.measurement_variable()),
    f"""SELECT CAST(date_trunc('month', day) AS DATE) AS date, station_id, variable_id, min(min_value) AS min_value,
      max(max_value) AS max_value, {r2('avg(avg_value)', 6)} AS avg_value, sum(sum_value) AS sum_value, count(*) AS num_days,
      v.symbol, u.symbol AS unit_symbol, m.name AS measurement_variable
    FROM climate_daily JOIN variable v ON v.id = variable_id JOIN unit u ON u.id = v.unit_id
      JOIN measurement_variable m ON m.id = v.measurement_variable_id
    GROUP BY 1, 2, 3, 9, 10, 11""",
)
register("completeness_daily", completeness, "SELECT * FROM completeness")
GRID = f"""SELECT g.station_id, g.variable_id, g.month, a.mean_value FROM
  (SELECT station_id, variable_id, CAST(x AS DATE) AS month FROM sv, range(DATE '2023-01-01', DATE '2025-01-01', INTERVAL 1 MONTH) r(x)) g
  LEFT JOIN (SELECT station_id, variable_id, CAST(date_trunc('month', datetime) AS DATE) AS month, {r2('avg(measured)')} AS mean_value
    FROM obs GROUP BY 1, 2, 3) a USING (station_id, variable_id, month)"""
register(
    "monthly_mean_grid",
    lambda t: summary.monthly_mean_grid(t.obs(), t.station_variable(), 2023, 2024),
    "SELECT * FROM mean_grid",
    mean_grid=GRID,
)
# margins over the multi-year climate, whose grid has several years
CLIMATE_GRID = f"""SELECT station_id, variable_id, CAST(date_trunc('month', day) AS DATE) AS month, {r2('avg(avg_value)')} AS mean_value
  FROM climate_daily GROUP BY 1, 2, 3"""


def climate_grid(t):
    from pyspark.sql import functions as F

    d = t.climate_daily().select(
        "station_id",
        "variable_id",
        F.col("day").cast("timestamp").alias("datetime"),
        F.col("avg_value").alias("measured"),
    )
    pairs = d.select("station_id", "variable_id").distinct()
    return summary.monthly_mean_grid(d, pairs, 1995, 2001)


register(
    "monthly_mean_margins",
    lambda t: summary.monthly_mean_margins(climate_grid(t)),
    f"""SELECT station_id, variable_id, year, NULL AS month_no, {r2('avg(mean_value)')} AS mean_value, count(*) AS cells, 'year' AS margin
      FROM (SELECT *, CAST(year(month) AS INT) AS year FROM climate_grid) GROUP BY 1, 2, 3
    UNION ALL SELECT station_id, variable_id, NULL, month_no, {r2('avg(mean_value)')}, count(*), 'month'
      FROM (SELECT *, CAST(month(month) AS INT) AS month_no FROM climate_grid) GROUP BY 1, 2, 4""",
    climate_grid=CLIMATE_GRID,
)

register(
    "column_stats_sample",
    lambda t: stats.column_stats_sample(t.obs(), ["station_id", "variable_id"]),
    f"""SELECT station_id, variable_id, sum(measured) AS sum_value, avg(measured) AS avg_value, min(measured) AS min_value,
      max(measured) AS max_value, {r2('coalesce(stddev_samp(measured), 0)', 6)} AS std_value, count(measured) AS num_records
    FROM obs WHERE measured <> -99.9 GROUP BY 1, 2""",
)
register(
    "column_stats_population",
    lambda t: stats.column_stats_population(t.obs(), ["station_id", "variable_id"]),
    f"""SELECT station_id, variable_id, sum(measured) AS sum_value, avg(measured) AS avg_value, min(measured) AS min_value,
      max(measured) AS max_value, arg_min(datetime, {{'m': measured, 'd': datetime}}) AS min_datetime,
      arg_min(datetime, {{'m': -measured, 'd': datetime}}) AS max_datetime,
      {r2('stddev_pop(measured)', 6)} AS std_value, count(measured) AS num_records
    FROM obs WHERE measured <> -99.9 GROUP BY 1, 2""",
)

DAYS = """SELECT *, CAST(month(day) AS INT) AS month, CAST(day(day) AS INT) AS day_of_month, CAST(year(day) AS INT) AS year FROM climate_daily"""
PART = "PARTITION BY station_id, variable_id, month, day_of_month"


def extreme_sql(value: str, order: str, mean: bool) -> str:
    extra = f", {r2e(f'avg({value}) OVER ({PART})')} AS value" if mean else ""
    return f"""SELECT station_id, variable_id, month, day_of_month, {r2e(value)} AS agg_value, year, count(*) OVER ({PART}) AS years {extra}
      FROM cdays QUALIFY rank() OVER ({PART} ORDER BY {value} {order}) = 1"""


EXTREMES = {
    "accumulation": (climatology.extremes_accumulation, extreme_sql("sum_value", "DESC", False)),
    "maximum": (climatology.extremes_maximum, extreme_sql("max_value", "DESC", True)),
    "minimum": (climatology.extremes_minimum, extreme_sql("min_value", "ASC", True)),
}
for kind, (fn, text) in EXTREMES.items():
    register(f"extremes_{kind}", lambda t, fn=fn: fn(t.climate_daily()), text, cdays=DAYS)
register(
    "daily_means",
    lambda t: climatology.daily_means(t.climate_daily()),
    f"SELECT station_id, variable_id, month, day_of_month, {r2e('avg(avg_value)')} AS value FROM cdays GROUP BY 1, 2, 3, 4",
    cdays=DAYS,
)


def month_summary(t):
    parts = [
        climatology.extremes_month_summary(fn(t.climate_daily()), kind) for kind, (fn, _) in EXTREMES.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


register(
    "extremes_month_summary",
    month_summary,
    f"""SELECT station_id, variable_id, month, 'accumulation' AS kind, max(agg_value) AS agg_value,
        arg_min(year, {{'v': -agg_value, 'd': day_of_month, 'y': year}}) AS year, NULL AS value FROM xa GROUP BY 1, 2, 3
    UNION ALL SELECT station_id, variable_id, month, 'maximum', max(agg_value),
        arg_min(year, {{'v': -agg_value, 'd': day_of_month, 'y': year}}), {r2e('avg(value)')} FROM xmax GROUP BY 1, 2, 3
    UNION ALL SELECT station_id, variable_id, month, 'minimum', min(agg_value),
        arg_min(year, {{'v': agg_value, 'd': day_of_month, 'y': year}}), {r2e('avg(value)')} FROM xmin GROUP BY 1, 2, 3""",
    cdays=DAYS,
    xa=EXTREMES["accumulation"][1],
    xmax=EXTREMES["maximum"][1],
    xmin=EXTREMES["minimum"][1],
)
register(
    "rolling_accumulation",
    lambda t: climatology.rolling_accumulation(t.obs_regular(), 60, 360),
    """SELECT datetime, station_id, variable_id, acc FROM (
      SELECT *, sum(measured) OVER (PARTITION BY station_id, variable_id ORDER BY datetime ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS acc,
        lag(datetime, 5) OVER (PARTITION BY station_id, variable_id ORDER BY datetime) AS earliest
      FROM obs_regular WHERE measured <> -99.9) WHERE datetime - earliest < INTERVAL 360 MINUTE""",
)
register(
    "latest_by_rank",
    lambda t: climatology.latest_by_rank(t.obs()),
    """SELECT station_id, variable_id, datetime, measured, code FROM obs
    QUALIFY row_number() OVER (PARTITION BY station_id, variable_id ORDER BY datetime DESC) = 1""",
)

SHARE = t2(r2("avg(record_count_percentage)", 6))
register(
    "inventory_yearly",
    lambda t: inventory.inventory_yearly(completeness(t), t.station_places(), 2023, 2025, True),
    f"""SELECT CAST(year(day) AS INT) AS year, station_id, name, code, is_automatic, begin_date, watershed, {SHARE} AS percentage
    FROM completeness JOIN station s ON s.id = station_id WHERE is_automatic GROUP BY ALL""",
)
register(
    "inventory_by_station",
    lambda t: inventory.inventory_by_station(completeness(t), t.station_variable(), t.variable(), 2023, 2025),
    f"""SELECT CAST(year(day) AS INT) AS year, c.station_id, c.variable_id, n.name, {SHARE} AS percentage
    FROM completeness c JOIN (SELECT station_id, variable_id, name FROM sv JOIN variable v ON v.id = variable_id) n USING (station_id, variable_id)
    GROUP BY ALL""",
)
register(
    "inventory_monthly",
    lambda t: inventory.inventory_monthly(completeness(t), t.variable(), t.measurement_variable(), 2024),
    f"""SELECT CAST(month(day) AS INT) AS month, station_id, variable_id, v.name,
      replace(lower(m.name), ' ', '-') AS measurement_variable_name, {SHARE} AS percentage
    FROM completeness JOIN variable v ON v.id = variable_id LEFT JOIN measurement_variable m ON m.id = v.measurement_variable_id
    GROUP BY ALL""",
)
RANGE_COUNT = """SELECT c.*, (SELECT count(*) FROM obs o WHERE o.station_id = c.station_id AND o.variable_id = c.variable_id
      AND o.datetime >= c.day AND o.datetime <= c.day + INTERVAL 1 DAY) AS qc_amount,
    (SELECT count(*) FROM obs o WHERE o.station_id = c.station_id AND o.variable_id = c.variable_id
      AND o.datetime >= c.day AND o.datetime <= c.day + INTERVAL 1 DAY AND coalesce(o.manual_flag, o.quality_flag) IN (1, 4)) AS qc_passed_amount
  FROM completeness c"""
register(
    "range_count_join",
    lambda t: inventory.range_count_join(completeness(t), t.obs()),
    "SELECT * FROM rcount",
    rcount=RANGE_COUNT,
)
register(
    "inventory_daily",
    lambda t: inventory.inventory_daily(completeness(t), t.obs(), 2024, 1),
    f"""SELECT g.station_id, g.variable_id, CAST(g.d AS INT) AS day,
      CAST(coalesce(dayofweek(c.day), (1 + g.d - 1) % 7) AS INT) AS dow,
      coalesce({t2('record_count_percentage')}, 0) AS percentage, coalesce(record_count, 0) AS record_count,
      coalesce(ideal_record_count, 0) AS ideal_record_count,
      CASE WHEN qc_amount = 0 THEN 0 ELSE {t2('CAST(qc_passed_amount AS DOUBLE) / qc_amount * 100')} END AS qc_passed_percentage
    FROM (SELECT station_id, variable_id, d FROM sv, range(1, 32) r(d)) g
      LEFT JOIN rcount c ON c.station_id = g.station_id AND c.variable_id = g.variable_id AND day(c.day) = g.d""",
    rcount=RANGE_COUNT,
)

BAND = """CASE WHEN {0} >= 20 THEN 'Good' WHEN {0} >= 8 THEN 'Suspicious' WHEN {0} >= 1 THEN 'Bad' ELSE 'Not checked' END"""
WORST = """CASE WHEN count(*) FILTER (quality_flag = 3) > 0 THEN 'Bad' WHEN count(*) FILTER (quality_flag = 2) > 0 THEN 'Suspicious'
  WHEN count(*) FILTER (quality_flag = 4) > 0 THEN 'Good' ELSE 'Not checked' END"""
FLAG_COUNTS = """count(*) FILTER (w = 'Good') AS good, count(*) FILTER (w = 'Suspicious') AS suspicious,
  count(*) FILTER (w = 'Bad') AS bad, count(*) FILTER (w = 'Not checked') AS not_checked"""
WEEK = "range(DATE '2024-01-09', DATE '2024-01-16', INTERVAL 1 DAY) r(x)"
IN_WEEK = "datetime >= TIMESTAMP '2024-01-08' AND datetime < TIMESTAMP '2024-01-16'"
IN_DAY = f"datetime <= {AS_OF} AND datetime >= {AS_OF} - INTERVAL 24 HOUR"
HS = f"SELECT station_id, variable_id, count(DISTINCT hour(datetime)) AS nh FROM hourly WHERE {IN_DAY} GROUP BY 1, 2"
register(
    "comm_daily_track",
    lambda t: monitor.comm_daily_track(hourly(t), t.station_variable(), t.flag(), WEEK_END),
    f"""SELECT g.*, coalesce(amount, 0) AS amount, color FROM
      (SELECT station_id, variable_id, CAST(x AS DATE) AS date FROM sv, {WEEK}) g
      LEFT JOIN (SELECT station_id, variable_id, CAST(datetime AS DATE) AS date, count(DISTINCT hour(datetime)) AS amount
        FROM hourly WHERE {IN_WEEK} GROUP BY 1, 2, 3) h USING (station_id, variable_id, date)
      JOIN flag f ON f.name = {BAND.format('coalesce(amount, 0)')}""",
)
register(
    "qc_daily_track",
    lambda t: monitor.qc_daily_track(t.obs(), t.station_variable(), WEEK_END),
    f"""SELECT g.station_id, g.variable_id, g.date, {FLAG_COUNTS} FROM
      (SELECT station_id, variable_id, CAST(x AS DATE) AS date FROM sv, {WEEK}) g
      LEFT JOIN (SELECT station_id, variable_id, CAST(datetime AS DATE) AS date, hour(datetime) AS hr, {WORST} AS w
        FROM obs WHERE {IN_WEEK} GROUP BY 1, 2, 3, 4) h USING (station_id, variable_id, date) GROUP BY 1, 2, 3""",
)
register(
    "comm_station_vars",
    lambda t: monitor.comm_station_vars(
        hourly(t), summary.last24h_summary(t.obs(), ASOF), t.station_variable(), t.variable(), t.unit(), t.flag(), ASOF
    ),
    f"""SELECT sv.station_id, sv.variable_id, v.name, coalesce(nh, 0) AS amount, latest_value, u.symbol AS unit_symbol, f.color
    FROM sv LEFT JOIN hs USING (station_id, variable_id) LEFT JOIN last24 USING (station_id, variable_id)
      LEFT JOIN variable v ON v.id = sv.variable_id LEFT JOIN unit u ON u.id = v.unit_id
      JOIN flag f ON f.name = {BAND.format('coalesce(nh, 0)')}""",
    hs=HS,
)
register(
    "qc_station_vars",
    lambda t: monitor.qc_station_vars(t.obs(), t.station_variable(), t.variable(), ASOF),
    f"""SELECT sv.station_id, sv.variable_id, v.name, {FLAG_COUNTS} FROM sv LEFT JOIN variable v ON v.id = sv.variable_id
      LEFT JOIN (SELECT station_id, variable_id, hour(datetime) AS hr, {WORST} AS w FROM obs WHERE {IN_DAY} GROUP BY 1, 2, 3) h
        ON h.station_id = sv.station_id AND h.variable_id = sv.variable_id GROUP BY 1, 2, 3""",
)
COMM_MAP = f"""SELECT s.id AS station_id, s.name, s.code, s.latitude, s.longitude, f.color
  FROM (SELECT s.id, s.name, s.code, s.latitude, s.longitude, max(nh) AS nh FROM station s LEFT JOIN sv ON sv.station_id = s.id
    LEFT JOIN hs ON hs.station_id = sv.station_id AND hs.variable_id = sv.variable_id WHERE %s GROUP BY ALL) s
  JOIN flag f ON f.name = {BAND.format('coalesce(nh, 0)')}"""
QC_MAP = f"""SELECT s.id AS station_id, s.name, s.code, s.latitude, s.longitude, f.color FROM station s
  LEFT JOIN (SELECT station_id, {WORST} AS w FROM obs WHERE {IN_DAY} GROUP BY 1) q ON q.station_id = s.id
  JOIN flag f ON f.name = coalesce(w, 'Not checked') WHERE %s"""
COVERS = "s.begin_date <= DATE '2024-01-15' AND (s.end_date IS NULL OR s.end_date >= DATE '2024-01-15')"
for suffix, on_date, where in (("", False, "s.is_active"), ("_on_date", True, COVERS)):
    register(
        f"comm_map{suffix}",
        lambda t, d=on_date: monitor.comm_map(hourly(t), t.station(), t.station_variable(), t.flag(), ASOF, d),
        COMM_MAP % where,
        hs=HS,
    )
    register(
        f"qc_map{suffix}",
        lambda t, d=on_date: monitor.qc_map(t.obs(), t.station(), t.flag(), ASOF, d),
        QC_MAP % where,
    )
register(
    "status_share",
    lambda t: stats.status_share(
        monitor.comm_map(hourly(t), t.station(), t.station_variable(), t.flag(), ASOF)
    ),
    f"""SELECT f.name, f.color, count(m.color) AS stations,
      {r2('count(m.color) * 100.0 / (SELECT count(*) FROM cmap)')} AS percentage
    FROM flag f LEFT JOIN cmap m ON m.color = f.color GROUP BY 1, 2""",
    hs=HS,
    cmap=COMM_MAP % "s.is_active",
)
register(
    "station_last_update",
    lambda t: monitor.station_last_update(latest(t)),
    "SELECT station_id, strftime(max(last_data_datetime), '%Y-%m-%d %H:%M') AS lastupdate FROM latest GROUP BY 1",
)
