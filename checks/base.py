"""DuckDB twins of the adapted tables, as named CTEs pulled in by name."""

from __future__ import annotations

import re

from pluvio import schema
from pluvio.sources import tables as t


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return str(v)


def values(rows, cols: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({cols})"


def reading(select_key: str, extra: str = "") -> str:
    return f"""
    SELECT {extra} event_id, {select_key},
      CASE WHEN event_id % 97 = 0 THEN CAST(-99.9 AS DOUBLE) ELSE floor(value * 8) / 8 END AS measured,
      CASE WHEN event_id % 53 = 0 THEN floor(value * 8) / 8 + 1 END AS consisted,
      CASE WHEN event_id % 10 <= 1 THEN 3 WHEN event_id % 10 = 2 THEN 2 WHEN event_id % 10 <= 4 THEN 1 ELSE 4 END AS quality_flag,
      CASE WHEN event_id % 31 = 0 THEN 4 WHEN event_id % 37 = 0 THEN 3 END AS manual_flag,
      event_id % 41 = 0 AS is_daily,
      CASE WHEN event_id % 29 = 0 THEN 'note ' || event_id END AS remarks,
      CASE WHEN event_id % 23 = 0 THEN 'obs ' || (event_id % 7) END AS observer,
      CASE WHEN event_type = 'view' THEN props END AS code,
      1 AS ml_flag
    FROM events"""


EVENT_KEY = """CAST(user_id // 5 AS INT) AS station_id,
      CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS variable_id,
      CASE WHEN event_id % 4 = 0 THEN date_trunc('hour', ts) ELSE date_trunc('minute', ts) END AS datetime"""

REGULAR_KEY = """CAST(event_id // 240 // 5 AS INT) AS station_id,
      CAST(event_id // 240 % 5 + 1 AS INT) AS variable_id,
      TIMESTAMP '2024-01-25 00:00:00' + to_hours(CAST(event_id % 240 + event_id % 240 // 20 AS INT)) AS datetime"""

AGG = """min(v) AS min_value, max(v) AS max_value, avg(v) AS avg_value, sum(v) AS sum_value, count(v) AS num_records"""
VALID = """coalesce(manual_flag, quality_flag) IN (1, 4) AND v <> -99.9"""


def r2(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def r2e(x: str, digits: int = 2) -> str:
    """Ties to even: only a tie differs from rounding half up, and half of it never is one."""
    d = f"CAST({x} AS DECIMAL(28,10))"
    return f"CAST(CASE WHEN abs(({d} * {10**digits}) % 1) = 0.5 THEN round({d} / 2, {digits}) * 2 ELSE round({d}, {digits}) END AS DOUBLE)"


def t2(x: str) -> str:
    return f"(CAST(floor(CAST({x} AS DECIMAL(28,10)) * 100) AS DOUBLE) / 100)"


PICK_LISTING = """CASE WHEN sampling_operation_id IN (1,2) THEN avg_value WHEN sampling_operation_id = 3 THEN min_value
   WHEN sampling_operation_id = 4 THEN max_value ELSE sum_value END"""
PICK_REPORT = """CASE WHEN sampling_operation_id IN (6,7) THEN sum_value WHEN sampling_operation_id = 3 THEN min_value
   WHEN sampling_operation_id = 4 THEN max_value ELSE avg_value END"""

AS_OF = "TIMESTAMP '2024-01-15 12:00:00'"

CTE: dict[str, str] = {
    "readings": reading(EVENT_KEY),
    "obs": """SELECT * EXCLUDE (event_id) FROM readings
      QUALIFY row_number() OVER (PARTITION BY station_id, variable_id, datetime ORDER BY event_id DESC) = 1""",
    "obs_regular": "SELECT * EXCLUDE (event_id) FROM (" + reading(REGULAR_KEY, "3600 AS seconds,") + ")",
    "hf": """SELECT CAST(event_id // 1800 AS INT) AS station_id, 9 AS variable_id,
      TIMESTAMP '2024-01-15 12:00:01' + to_seconds(event_id % 1800) AS datetime, floor(value * 8) / 8 AS measured FROM events""",
    "climate_daily": """SELECT CAST(l_suppkey AS INT) AS station_id,
      CASE l_returnflag WHEN 'A' THEN 6 WHEN 'N' THEN 7 ELSE 8 END AS variable_id, CAST(l_shipdate AS DATE) AS day,
      min(l_quantity) AS min_value, max(l_quantity) AS max_value, avg(l_quantity) AS avg_value,
      sum(l_quantity) AS sum_value, count(l_quantity) AS num_records FROM lineitem GROUP BY 1, 2, 3""",
    "station": """SELECT CAST(s_suppkey AS INT) AS id, s_name AS name, 'ST' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code,
      'alias ' || (s_suppkey % 50) AS alias_name, 'site ' || s_suppkey AS alternative_names,
      CAST(150 + s_suppkey * 37 % 40 AS DOUBLE) / 10 AS latitude, CAST(-900 + s_suppkey * 53 % 30 AS DOUBLE) / 10 AS longitude,
      CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey + 1 AS INT) END AS reference_station_id,
      CAST((s_suppkey % 5 - 2) * 180 AS INT) AS utc_offset_minutes, s_suppkey % 7 <> 6 AS is_active,
      s_suppkey % 2 = 0 AS is_automatic, n_name AS region, r_name AS watershed, CAST(s_suppkey % 4 AS INT) AS profile_id,
      DATE '2023-06-01' AS begin_date, CASE WHEN s_suppkey % 6 = 5 THEN DATE '2024-01-10' END AS end_date
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "variable": values(
        t.VARIABLES,
        "id, symbol, name, variable_type, sampling_operation_id, unit_id, measurement_variable_id, color, range_min,"
        " range_max, range_min_hourly, range_max_hourly, step, step_hourly, persistence, persistence_hourly,"
        " persistence_window, persistence_window_hourly",
    ),
    "unit": values(t.UNITS, "id, symbol, name"),
    "measurement_variable": values(t.MEASUREMENT_VARIABLES, "id, name"),
    "flag": values(schema.FLAGS, "id, symbol, name, color"),
    "sv": "SELECT id AS station_id, CAST(u AS INT) AS variable_id FROM station, range(1, 6) r(u)",
    "thr_owner": """SELECT id AS station_id, CASE WHEN id % 4 = 0 THEN 3600 END AS ivl, CAST(u AS INT) AS variable_id
      FROM station, range(1, 5) r(u) WHERE id % 4 <= 1 AND (id % 4 = 1 OR u <= 2)""",
    "range_thr": """SELECT station_id, variable_id, ivl, m AS month, CAST(station_id % 5 + variable_id AS DOUBLE) AS range_min,
      CAST(60 + station_id % 50 AS DOUBLE) AS range_max FROM thr_owner, (VALUES (1), (2)) mm(m)""",
    "step_thr": """SELECT station_id, variable_id, ivl, -CAST(20 + station_id % 10 AS DOUBLE) AS step_min,
      CAST(20 + station_id % 10 AS DOUBLE) AS step_max FROM thr_owner""",
    "persist_thr": """SELECT o.station_id, o.variable_id, o.ivl, w.wnd, CAST(3 + o.station_id % 5 AS DOUBLE) AS minimum_variance
      FROM thr_owner o JOIN (SELECT id, coalesce(persistence_window, 96) * 3600 AS wnd FROM variable
        UNION ALL SELECT id, coalesce(persistence_window_hourly, 1) * 3600 FROM variable) w ON w.id = o.variable_id""",
    "calc": "SELECT *, coalesce(consisted, measured) AS v FROM obs",
    "hourly": f"""SELECT CASE WHEN NOT is_daily AND datetime = date_trunc('day', datetime)
        THEN date_trunc('hour', datetime - INTERVAL 1 SECOND) ELSE date_trunc('hour', datetime) END AS datetime,
      station_id, variable_id, is_daily, {AGG} FROM calc WHERE {VALID} GROUP BY 1, 2, 3, 4""",
    "daily": f"""SELECT CAST(datetime + to_minutes(utc_offset_minutes) - CASE WHEN is_daily THEN INTERVAL 0 SECOND ELSE INTERVAL 1 SECOND END AS DATE) AS day,
      station_id, variable_id, is_daily, {AGG} FROM calc JOIN station s ON s.id = station_id WHERE {VALID} GROUP BY 1, 2, 3, 4""",
    "monthly": """SELECT CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, CAST(date_trunc('month', day) AS DATE) AS date, station_id, variable_id,
      min(min_value) AS min_value, max(max_value) AS max_value, sum(sum_value) / sum(num_records) AS avg_value,
      sum(sum_value) AS sum_value, CAST(sum(num_records) AS BIGINT) AS num_records FROM climate_daily GROUP BY 1, 2, 3, 4, 5""",
    "yearly": """SELECT CAST(year(day) AS INT) AS year, CAST(date_trunc('year', day) AS DATE) AS date, station_id, variable_id,
      min(min_value) AS min_value, max(max_value) AS max_value, sum(sum_value) / sum(num_records) AS avg_value,
      sum(sum_value) AS sum_value, CAST(sum(num_records) AS BIGINT) AS num_records FROM climate_daily GROUP BY 1, 2, 3, 4""",
    "last24": f"""SELECT {AS_OF} AS datetime, station_id, variable_id,
      min(v) FILTER (v <> -99.9) AS min_value, max(v) FILTER (v <> -99.9) AS max_value, avg(v) FILTER (v <> -99.9) AS avg_value,
      sum(v) FILTER (v <> -99.9) AS sum_value, count(v) FILTER (v <> -99.9) AS num_records,
      arg_max(v, datetime) FILTER (measured <> -99.9) AS latest_value
      FROM calc WHERE datetime > {AS_OF} - INTERVAL 1 DAY AND datetime <= {AS_OF}
        AND (consisted IS NOT NULL OR quality_flag IN (1, 4)) AND NOT is_daily
      GROUP BY station_id, variable_id
      HAVING count(*) FILTER (v <> -99.9) > 0 AND count(*) FILTER (measured <> -99.9) > 0""",
    "latest": """SELECT station_id, variable_id, max(datetime) AS last_data_datetime, arg_max(measured, datetime) AS last_data_value,
      arg_max(coalesce(code, '<none>'), datetime) AS code0 FROM obs GROUP BY 1, 2""",
    "completeness": """
      SELECT g.day, g.station_id, g.variable_id, min(d.gap) AS minimum_interval, count(d.day) AS record_count,
        coalesce(CAST(round(86400 / CAST(min(d.gap) AS DOUBLE)) AS INT), 0) AS ideal_record_count,
        coalesce(CAST(count(d.day) AS DOUBLE) / (86400 / CAST(min(d.gap) AS DOUBLE)) * 100, 0) AS record_count_percentage
      FROM (SELECT CAST(x AS DATE) AS day, station_id, variable_id FROM sv, range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) r(x)) g
      LEFT JOIN (
        SELECT day, station_id, variable_id, CASE WHEN is_daily THEN 86400 ELSE
          CAST(epoch(lead(datetime) OVER (PARTITION BY station_id, variable_id, day ORDER BY datetime) - datetime) AS BIGINT) END AS gap
        FROM (SELECT *, CAST(datetime + to_minutes(utc_offset_minutes) - INTERVAL 1 SECOND AS DATE) AS day
              FROM obs JOIN station s ON s.id = station_id)) d
      ON d.day = g.day AND d.station_id = g.station_id AND d.variable_id = g.variable_id
      GROUP BY 1, 2, 3""",
}


def sql(body: str, **extra: str) -> str:
    """``body`` with every CTE it (transitively) names; ``extra`` adds query-local CTEs."""
    defs = {**CTE, **{k: v for k, v in extra.items()}}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in defs:
            if name not in order and re.search(rf"(?<![\w.']){name}\b(?!')", text):
                # mark first to stop cycles on names used as columns
                order.append(name)
                pos = len(order) - 1
                visit(defs[name])
                order.remove(name)
                order.append(name)
                del pos

    visit(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({defs[n]})" for n in order) + "\n" + body
