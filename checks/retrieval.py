"""Lists, maps, forms, reports, exports."""

import datetime as dt

from pyspark.sql import functions as F

from checks.base import AS_OF, PICK_LISTING, PICK_REPORT, r2e
from checks.registry import register
from checks.summaries import ASOF, daily, hourly, latest
from pluvio.operators import gapfill, retrieve, summary

VU = "JOIN variable v ON v.id = a.variable_id {left} JOIN unit u ON u.id = v.unit_id"
NAMES = "v.symbol AS variable_symbol, v.name AS variable_name, u.name AS unit_name, u.symbol AS unit_symbol"
LATEST = """SELECT station_id, variable_id, datetime AS last_data_datetime, measured AS last_data_value, code AS last_data_code FROM obs
  QUALIFY row_number() OVER (PARTITION BY station_id, variable_id ORDER BY datetime DESC) = 1"""

register(
    "raw_list",
    lambda t: retrieve.raw_list(t.obs(), t.variable(), t.unit(), t.flag()),
    f"""SELECT station_id, variable_id, datetime, CASE WHEN lower(v.variable_type) <> 'code' THEN {r2e('measured')} END AS value,
      CASE WHEN lower(v.variable_type) = 'code' THEN code END AS code, {NAMES}, f.symbol AS flag_symbol
    FROM obs a {VU.format(left='LEFT')} JOIN flag f ON f.id = quality_flag""",
)


def list_sql(table: str, at: str) -> str:
    return f"""SELECT a.{at}, station_id, variable_id, {r2e(PICK_LISTING)} AS value, {r2e('min_value')} AS min, {r2e('max_value')} AS max,
      {r2e('avg_value')} AS avg, {r2e('sum_value')} AS sum, num_records AS count, {NAMES} FROM {table} a {VU.format(left='')}"""


register("hourly_list", lambda t: retrieve.summary_list(hourly(t), t.variable(), t.unit(), "hourly"), list_sql("hourly", "datetime"))
register("daily_list", lambda t: retrieve.summary_list(daily(t), t.variable(), t.unit(), "daily"), list_sql("daily", "day"))


def monthly(t):
    return summary.monthly_summary(t.climate_daily())


def yearly(t):
    return summary.yearly_summary(t.climate_daily())


register("monthly_list", lambda t: retrieve.summary_list(monthly(t), t.variable(), t.unit(), "monthly"), list_sql("monthly", "date"))
register("yearly_list", lambda t: retrieve.summary_list(yearly(t), t.variable(), t.unit(), "yearly"), list_sql("yearly", "date"))

PICK24 = """CASE sampling_operation_id WHEN 1 THEN latest_value WHEN 2 THEN avg_value WHEN 3 THEN min_value WHEN 4 THEN max_value WHEN 6 THEN sum_value END"""


def last24(t):
    return summary.last24h_summary(t.obs(), ASOF)


register(
    "last24_list",
    lambda t: retrieve.last24_list(last24(t), t.variable(), t.unit()),
    f"""SELECT station_id, variable_id, {PICK24} AS value, {r2e('min_value')} AS min, {r2e('max_value')} AS max,
      {r2e('avg_value')} AS avg, {r2e('sum_value')} AS sum, num_records AS count, {NAMES} FROM last24 a {VU.format(left='')}""",
)
NEWEST = """SELECT * FROM lastrow l WHERE last_data_value IS NOT NULL AND last_data_datetime = (SELECT max(m.last_data_datetime) FROM lastrow m
   WHERE m.station_id = l.station_id AND m.last_data_value IS NOT NULL)"""
SHOWN = "CASE WHEN lower(v.variable_type) = 'code' THEN last_data_code ELSE CAST(last_data_value AS VARCHAR) END AS value"
LCTE = dict(lastrow=LATEST, newest=NEWEST)
register(
    "latest_for_station",
    lambda t: retrieve.latest_for_station(latest(t), t.variable(), t.unit()),
    f"SELECT station_id, variable_id, {SHOWN}, last_data_datetime, {NAMES} FROM newest a {VU.format(left='LEFT')}",
    **LCTE,
)
register(
    "latest_for_variable_map",
    lambda t: retrieve.latest_for_variable_map(latest(t), t.variable(), t.unit(), t.station()),
    f"""SELECT station_id, variable_id, {SHOWN}, s.longitude, s.latitude, u.symbol AS unit_symbol
    FROM newest a {VU.format(left='LEFT')} JOIN station s ON s.id = station_id""",
    **LCTE,
)
PICKDAY = """CASE WHEN sampling_operation_id IN (1, 2) THEN avg_value WHEN sampling_operation_id = 3 THEN min_value
  WHEN sampling_operation_id = 4 THEN max_value WHEN sampling_operation_id = 6 THEN sum_value END"""
TODAY = dt.date(2024, 1, 15)
CUR = f"SELECT day, station_id, variable_id, {PICKDAY} AS value, {NAMES} FROM daily a {VU.format(left='')} WHERE day = DATE '2024-01-15'"
register("current_day", lambda t: retrieve.current_day(daily(t), t.variable(), t.unit(), TODAY), CUR)


def livedata(t):
    return retrieve.livedata_bundle(
        retrieve.last24_list(last24(t), t.variable(), t.unit()),
        retrieve.latest_for_station(latest(t), t.variable(), t.unit()),
        retrieve.current_day(daily(t), t.variable(), t.unit(), TODAY),
    )


register(
    "livedata_bundle",
    livedata,
    f"""SELECT 'past24h' AS section, station_id, variable_id, CAST({PICK24} AS VARCHAR) AS value, {NAMES} FROM last24 a {VU.format(left='')}
    UNION ALL SELECT 'latest', station_id, variable_id, {SHOWN}, {NAMES} FROM newest a {VU.format(left='LEFT')}
    UNION ALL SELECT 'current_day', station_id, variable_id, CAST(value AS VARCHAR), variable_symbol, variable_name, unit_name, unit_symbol FROM cur""",
    cur=CUR,
    **LCTE,
)


register(
    "raw_last_24h_local",
    lambda t: retrieve.raw_last_24h_local(t.obs(), t.station(), t.variable(), t.unit(), ASOF).select(
        "station_id",
        "local_datetime",
        F.concat_ws(
            "; ", F.transform("readings", lambda r: F.concat_ws("|", r.variable_name, r.unit_symbol, r.measured.cast("string")))
        ).alias("readings"),
    ),
    f"""SELECT station_id, strftime(datetime + to_minutes(s.utc_offset_minutes), '%Y-%m-%d %H:%M:%S') AS local_datetime,
      string_agg(concat_ws('|', v.name, u.symbol, CAST(measured AS VARCHAR)), '; ' ORDER BY v.name) AS readings
    FROM obs a {VU.format(left='LEFT')} JOIN station s ON s.id = station_id
    WHERE datetime >= {AS_OF} - INTERVAL 1 DAY AND measured <> -99.9 GROUP BY 1, 2""",
)
register(
    "form_grid_12h",
    lambda t: retrieve.form_grid_12h(t.obs(), t.station_variable(), dt.date(2024, 1, 1)),
    """SELECT sv.station_id, sv.variable_id, CAST(x AS DATE) AS day, a.measured AS value_06am, p.measured AS value_06pm
    FROM sv CROSS JOIN range(DATE '2024-01-01', DATE '2024-02-01', INTERVAL 1 DAY) r(x)
      LEFT JOIN obs a ON a.station_id = sv.station_id AND a.variable_id = sv.variable_id AND a.datetime = x + INTERVAL 6 HOUR
      LEFT JOIN obs p ON p.station_id = sv.station_id AND p.variable_id = sv.variable_id AND p.datetime = x + INTERVAL 18 HOUR""",
)
register(
    "capture_day_load",
    lambda t: retrieve.capture_day_load(t.obs(), t.variable(), t.station(), dt.date(2024, 1, 10)),
    """SELECT datetime + to_minutes(s.utc_offset_minutes) AS local_datetime, station_id, variable_id,
      CASE WHEN lower(v.variable_type) = 'code' THEN o.code ELSE CAST(measured AS VARCHAR) END AS value, remarks, observer
    FROM obs o JOIN station s ON s.id = station_id JOIN variable v ON v.id = variable_id
    WHERE datetime >= TIMESTAMP '2024-01-10' - to_minutes(s.utc_offset_minutes)
      AND datetime < TIMESTAMP '2024-01-11' - to_minutes(s.utc_offset_minutes)""",
)
register(
    "capture_month_load",
    lambda t: retrieve.capture_month_load(t.obs(), t.station(), dt.date(2024, 1, 1)),
    """SELECT datetime + to_minutes(s.utc_offset_minutes) AS local_datetime, station_id, variable_id, measured
    FROM obs JOIN station s ON s.id = station_id WHERE datetime >= TIMESTAMP '2024-01-01' AND datetime <= TIMESTAMP '2024-01-31'""",
)

RAW_REPORT = f"""SELECT m.name AS measurement_variable, v.symbol AS variable_symbol, station_id, epoch_ms(datetime) AS epoch_ms, {r2e('measured')} AS value,
   u.symbol AS unit_symbol, v.color, f.name AS flag_name, f.color AS flag_color
   FROM obs a {VU.format(left='')} JOIN measurement_variable m ON m.id = v.measurement_variable_id JOIN flag f ON f.id = quality_flag"""


def report_sql(table: str, at: str) -> str:
    return f"""SELECT m.name AS measurement_variable, v.symbol AS variable_symbol, station_id, epoch_ms(CAST(a.{at} AS TIMESTAMP)) AS epoch_ms,
      {r2e(PICK_REPORT)} AS value, u.symbol AS unit_symbol, v.color, NULL AS flag_name, NULL AS flag_color
      FROM {table} a {VU.format(left='')} JOIN measurement_variable m ON m.id = v.measurement_variable_id"""


def report(t, rows, source):
    return retrieve.report_series(rows, source, t.variable(), t.unit(), t.measurement_variable(), t.flag())


register("report_series", lambda t: report(t, t.obs(), "raw"), RAW_REPORT)
register("report_series_hourly", lambda t: report(t, hourly(t), "hourly"), report_sql("hourly", "datetime"))
register("report_series_daily", lambda t: report(t, daily(t), "daily"), report_sql("daily", "day"))
register("report_series_monthly", lambda t: report(t, monthly(t), "monthly"), report_sql("monthly", "date"))
register("report_series_yearly", lambda t: report(t, yearly(t), "yearly"), report_sql("yearly", "date"))
register(
    "compare_stations",
    lambda t: retrieve.compare_stations(
        hourly(t), "hourly", t.station_variable(), t.station(), t.variable(), t.unit()
    ),
    f"""SELECT s.name AS station_name, v.name AS variable_name, a.station_id, epoch_ms(datetime) AS epoch_ms, {r2e(PICK_REPORT)} AS value,
      u.symbol AS unit_symbol, v.color, NULL AS flag_name, NULL AS flag_color
    FROM hourly a {VU.format(left='')} JOIN sv USING (station_id, variable_id) JOIN station s ON s.id = a.station_id""",
)
POINT = "s.name, s.code, s.latitude, s.longitude"
register(
    "spatial_points_instant",
    lambda t: retrieve.spatial_points_instant(t.obs(), "raw", t.station(), t.variable(), quality_flags=[1, 4]),
    f"""SELECT datetime, station_id, variable_id, {POINT}, measured FROM obs JOIN station s ON s.id = station_id
    WHERE measured <> -99.9 AND quality_flag IN (1, 4)""",
)
register(
    "spatial_points_aggregated",
    lambda t: retrieve.spatial_points_aggregated(
        hourly(t), "hourly", t.station(), t.variable(), "max", "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    ),
    f"""SELECT station_id, variable_id, {POINT}, max({PICK_REPORT}) AS measured FROM hourly JOIN variable v ON v.id = variable_id
      JOIN station s ON s.id = station_id WHERE datetime >= TIMESTAMP '2024-01-05' AND datetime <= TIMESTAMP '2024-01-20'
    GROUP BY ALL""",
)
register(
    "spatial_points_median",
    lambda t: retrieve.spatial_points_aggregated(t.obs(), "raw", t.station(), t.variable(), "median"),
    f"""SELECT station_id, variable_id, {POINT}, median(measured) AS measured FROM obs JOIN station s ON s.id = station_id
    WHERE measured <> -99.9 GROUP BY ALL""",
)
register(
    "spatial_points_summary",
    lambda t: retrieve.spatial_points_summary(t.climate_daily(), "daily", t.station()),
    """SELECT day, station_id, variable_id, s.latitude, s.longitude, avg_value AS value FROM climate_daily JOIN station s ON s.id = station_id""",
)

T0, T1 = "2024-01-10 00:00:00", "2024-01-13 00:00:00"
GAPRAW = """SELECT g.station_id, g.variable_id, x + to_minutes(s.utc_offset_minutes) AS datetime, coalesce(p.value, '-99.9') AS value
  FROM (SELECT station_id, variable_id, x FROM sv, range(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-13', INTERVAL {step} SECOND) r(x)) g
    JOIN station s ON s.id = g.station_id
    LEFT JOIN (SELECT station_id, variable_id, datetime, CASE WHEN lower(v.variable_type) = 'code' THEN code ELSE CAST(measured AS VARCHAR) END AS value
      FROM obs JOIN variable v ON v.id = variable_id) p ON p.station_id = g.station_id AND p.variable_id = g.variable_id AND p.datetime = x"""
register(
    "export_gapfill_raw",
    lambda t: gapfill.export_gapfill_raw(t.obs(), t.station_variable(), t.variable(), t.station(), T0, T1, 1800),
    GAPRAW.format(step=1800),
)


def gap_sql(table: str, at: str, grid: str, shift: str = "x") -> str:
    return f"""SELECT g.station_id, g.variable_id, {shift} AS datetime, coalesce(p.value, -99.9) AS value
      FROM (SELECT station_id, variable_id, CAST(x AS TIMESTAMP) AS x FROM sv, {grid} r(x)) g JOIN station s ON s.id = g.station_id
      LEFT JOIN (SELECT station_id, variable_id, {at} AS at, {PICK_LISTING} AS value FROM {table} JOIN variable v ON v.id = variable_id) p
        ON p.station_id = g.station_id AND p.variable_id = g.variable_id AND CAST(p.at AS TIMESTAMP) = x"""


def gap(t, rows, source, start=T0, end=T1, pairs=None):
    pairs = t.station_variable() if pairs is None else pairs
    return gapfill.export_gapfill_summary(rows, source, pairs, t.variable(), t.station(), start, end)


def climate_pairs(t):
    return t.station().select(
        F.col("id").alias("station_id"), F.explode(F.sequence(F.lit(6), F.lit(8))).alias("variable_id")
    )


GAP_HOURLY = gap_sql(
    "hourly",
    "datetime",
    "range(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-13', INTERVAL 1 HOUR)",
    "x + to_minutes(s.utc_offset_minutes)",
)
CSV = "SELECT id AS station_id, CAST(u AS INT) AS variable_id FROM station, range(6, 9) r(u)"
register("export_gapfill_summary", lambda t: gap(t, hourly(t), "hourly"), GAP_HOURLY)
register(
    "export_gapfill_daily",
    lambda t: gap(t, t.climate_daily(), "daily", "1998-01-01 00:00:00", "1998-03-01 00:00:00", climate_pairs(t)),
    gap_sql("climate_daily", "day", "range(DATE '1998-01-01', DATE '1998-03-01', INTERVAL 1 DAY)").replace("FROM sv,", "FROM csv,"),
    csv=CSV,
)
register(
    "export_gapfill_monthly",
    lambda t: gap(t, monthly(t), "monthly", "1995-01-01 00:00:00", "2001-12-01 00:00:00", climate_pairs(t)),
    gap_sql(
        "(SELECT * FROM monthly WHERE date < DATE '2001-12-01')",
        "date",
        "range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 MONTH)",
    ).replace("FROM sv,", "FROM csv,"),
    csv=CSV,
)
register(
    "export_gapfill_yearly",
    lambda t: gap(t, yearly(t), "yearly", "1995-01-01 00:00:00", "2001-01-01 00:00:00", climate_pairs(t)),
    gap_sql(
        "(SELECT * FROM yearly WHERE date < DATE '2001-01-01')",
        "date",
        "range(DATE '1995-01-01', DATE '2002-01-01', INTERVAL 1 YEAR)",
    ).replace("FROM sv,", "FROM csv,"),
    csv=CSV,
)
SYMBOLS = ["CLK", "ERR", "PUR", "SGN", "VIEW"]


def wide(t):
    return gapfill.export_pivot_wide(gap(t, hourly(t), "hourly"), t.variable(), "hourly", SYMBOLS)


register(
    "export_pivot_wide",
    wide,
    "SELECT station_id, strftime(datetime, '%Y') AS Year, strftime(datetime, '%m') AS Month, strftime(datetime, '%d') AS Day,"
    " strftime(datetime, '%H:%M:%S') AS Time, "
    + ", ".join(f"min(value) FILTER (v.symbol = '{s}') AS {s}" for s in SYMBOLS)
    + " FROM gaphourly JOIN variable v ON v.id = variable_id GROUP BY station_id, datetime",
    gaphourly=GAP_HOURLY,
)


def export_csv(t):
    """Writes the export and reads it back."""
    from pluvio.session import shared_dir

    path = shared_dir(t.spark, "export-csv")
    gapfill.export_station_csv(wide(t), path)
    schema = "Year string, Month string, Day string, Time string, " + ", ".join(f"{s} double" for s in SYMBOLS)
    return t.spark.read.schema(schema + ", station_id int").option("header", True).csv(path)


register(
    "export_station_csv",
    export_csv,
    "SELECT station_id, strftime(datetime, '%Y') AS Year, strftime(datetime, '%m') AS Month, strftime(datetime, '%d') AS Day,"
    " strftime(datetime, '%H:%M:%S') AS Time, "
    + ", ".join(f"min(value) FILTER (v.symbol = '{s}') AS {s}" for s in SYMBOLS)
    + " FROM gaphourly JOIN variable v ON v.id = variable_id GROUP BY station_id, datetime",
    gaphourly=GAP_HOURLY,
)
register(
    "export_preamble",
    lambda t: gapfill.export_preamble(
        t.station(), "CLK - Click rate (n)", "Hourly", T0, T1, dt.datetime(2024, 1, 16), "office"
    ),
    """SELECT station_id, CAST(n - 1 AS INT) AS line_no, lines[n] AS line FROM (SELECT id AS station_id, ['Station:,' || code || ' - ' || name,
       'Data source:,Hourly', 'Description:,CLK - Click rate (n)', 'Latitude:,' || latitude, 'Longitude:,' || longitude,
       'Date of completion:,2024-01-16 00:00:00', 'Prepared by:,office',
       'Start date:,' || strftime(TIMESTAMP '2024-01-10' + to_minutes(utc_offset_minutes), '%Y-%m-%d %H:%M:%S') || ',End date:,' ||
         strftime(TIMESTAMP '2024-01-13' + to_minutes(utc_offset_minutes), '%Y-%m-%d %H:%M:%S')] AS lines FROM station), range(1, 9) r(n)""",
)
register(
    "series_nested_json",
    lambda t: gapfill.series_nested_json(report(t, t.obs(), "raw")),
    f"""SELECT measurement_variable, variable_symbol, station_id, day,
      '{{"color":"' || color || '","unit":"' || unit_symbol || '","data":[' ||
        string_agg('{{"epoch_ms":' || epoch_ms || ',"value":' || value || ',"flag_name":"' || flag_name || '","flag_color":"' || flag_color || '"}}', ',' ORDER BY epoch_ms)
        || ']}}' AS payload
    FROM (SELECT *, CAST(make_timestamp(epoch_ms * 1000) AS DATE) AS day FROM rawreport) GROUP BY 1, 2, 3, 4, color, unit_symbol""",
    rawreport=RAW_REPORT,
)

register(
    "variable_labels",
    lambda t: retrieve.variable_labels(t.variable(), t.unit()).join(
        t.station_variable().groupBy("variable_id").agg(F.count(F.lit(1)).alias("stations")), "variable_id"
    ),
    """SELECT v.id AS variable_id, CASE WHEN u.symbol IS NOT NULL THEN v.symbol || ' - ' || v.name || ' (' || u.symbol || ')'
      ELSE v.symbol || ' - ' || v.name END AS label, count(*) AS stations
    FROM variable v LEFT JOIN unit u ON u.id = v.unit_id JOIN sv ON sv.variable_id = v.id GROUP BY 1, 2""",
)
register(
    "station_filter",
    lambda t: retrieve.station_filter(t.station_places(), watershed="ASIA", is_active=True, name_contains="SUPPLIER#0"),
    "SELECT * FROM station WHERE watershed = 'ASIA' AND is_active AND name ILIKE '%supplier#0%'",
)
register(
    "stations_with_variable",
    lambda t: retrieve.stations_with_variable(latest(t), t.station(), [1, 3]),
    "SELECT id, name, code FROM station WHERE id IN (SELECT station_id FROM obs WHERE variable_id IN (1, 3))",
)
register(
    "station_variable_detail",
    lambda t: retrieve.station_variable_detail(
        latest(t), t.station_variable(), t.variable(), t.unit(), t.measurement_variable()
    ),
    """SELECT sv.station_id, sv.variable_id, v.symbol AS variable_symbol, v.name AS variable_name, v.color, u.symbol AS unit_symbol,
      m.name AS measurement_variable, replace(lower(m.name), ' ', '-') AS measurement_variable_slug, last_data_datetime, last_data_value, last_data_code
    FROM sv LEFT JOIN lastrow USING (station_id, variable_id) LEFT JOIN variable v ON v.id = sv.variable_id
      LEFT JOIN unit u ON u.id = v.unit_id LEFT JOIN measurement_variable m ON m.id = v.measurement_variable_id""",
    **LCTE,
)


def sheet_names(t):
    s = t.station()
    return (
        s.select(F.col("name").alias("sheet_name"))
        .union(s.select("alias_name"))
        .union(s.select("alternative_names"))
        .union(s.select(F.concat(F.lit("unknown "), "code")))
        .distinct()
    )


register(
    "resolve_station_by_name",
    lambda t: retrieve.resolve_station_by_name(sheet_names(t), t.station()),
    """SELECT n.sheet_name, coalesce(a.id, b.id, c.id) AS station_id,
      CASE WHEN coalesce(a.id, b.id, c.id) IS NULL THEN 'Failed to find station by name ' || n.sheet_name END AS error
    FROM (SELECT name AS sheet_name FROM station UNION SELECT alias_name FROM station UNION SELECT alternative_names FROM station
        UNION SELECT 'unknown ' || code FROM station) n
      LEFT JOIN (SELECT name, min(id) AS id FROM station WHERE NOT is_automatic GROUP BY 1 HAVING count(*) = 1) a ON a.name = sheet_name
      LEFT JOIN (SELECT alias_name, min(id) AS id FROM station WHERE NOT is_automatic GROUP BY 1 HAVING count(*) = 1) b ON b.alias_name = sheet_name
      LEFT JOIN (SELECT alternative_names, min(id) AS id FROM station WHERE NOT is_automatic GROUP BY 1 HAVING count(*) = 1) c ON c.alternative_names = sheet_name""",
)
