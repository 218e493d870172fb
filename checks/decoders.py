"""Decoders, on messages and files that Spark writes from the given tables."""

import functools

from pyspark.sql import functions as F

from checks.places import CURVES, POINTS, curves, flow_sql, points
from checks.registry import register
from pluvio.plans import ingest
from pluvio.session import stored
from pluvio.sources import lightning, loggers, manifest, satellite, sheets

QUOTE = '"'


def quoted(*columns):
    return F.concat_ws(",", *[F.concat(F.lit(QUOTE), c, F.lit(QUOTE)) for c in columns])


def local_readings(t):
    s = t.station().select(F.col("id").alias("station_id"), "code", "utc_offset_minutes").withColumnRenamed(
        "code", "station_code"
    )
    return t.event_readings().join(s, "station_id").withColumn(
        "local", F.timestamp_seconds(F.unix_seconds("datetime") + F.col("utc_offset_minutes") * 60)
    )


def cell(variable: int):
    e = F.col("event_id")
    text = F.when(e % 13 == 0, "NAN").when(e % 17 == 0, "").otherwise(F.col("measured").cast("string"))
    return F.when(F.col("variable_id") == variable, text).otherwise("NAN")


def logger_format(t):
    return t._literal(
        [("CLK_Avg", 1, 3600), ("ERR_Avg", 2, 600), ("PUR_Tot", 3, 300), ("SGN_Min", 4, 60)],
        "lookup_key string, variable_id int, seconds int",
    )


def logger_lines(t):
    """A file per station and day; odd stations order their columns the other way round."""
    rows = local_readings(t).withColumn(
        "path", F.concat(F.lit("file:/in/"), "station_code", F.date_format("local", "_yyyyMMdd"), F.lit(".dat"))
    )
    odd = F.col("station_id") % 2 == 1
    names = ["CLK_Avg", "ERR_Avg", "PUR_Tot", "SGN_Min", "X_raw"]
    cells = [cell(v) for v in (1, 2, 3, 4, 5)]
    # some loggers leave a NUL byte behind the value
    cells[0] = F.when(F.col("event_id") % 19 == 0, F.concat(cells[0], F.char(F.lit(0)))).otherwise(cells[0])

    def line(first, record, values):
        return F.concat_ws(",", first, record, *[F.when(odd, b).otherwise(a) for a, b in zip(values, values[::-1])])

    stamp = F.concat(F.lit(QUOTE), F.date_format("local", "yyyy-MM-dd HH:mm:ss"), F.lit(QUOTE))
    data = rows.select("path", line(stamp, F.col("event_id").cast("string"), cells).alias("line"))
    header = F.array(
        F.concat(F.lit('"TOA5","'), "station_code", F.lit('_site","CR300","1","CR300.Std.06"')),
        line(F.lit('"TIMESTAMP"'), F.lit('"RECORD"'), [F.lit(f'"{n}"') for n in names]),
        F.lit('"TS","RN","n","n","n","n","n"'),
        F.lit('"","","Avg","Avg","Tot","Min","Smp"'),
    )
    files = rows.select("path", "station_id", "station_code").distinct()
    return data.unionByName(files.select("path", F.explode(header).alias("line")))


CELLS = """SELECT station_id, variable_id, {seconds} AS seconds, datetime, measured, {flag} AS quality_flag, false AS is_daily
  FROM readings WHERE variable_id < 5 AND event_id % 13 <> 0 AND event_id % 17 <> 0"""
SECONDS = "CASE variable_id WHEN 1 THEN 3600 WHEN 2 THEN 600 WHEN 3 THEN 300 ELSE 60 END"
register(
    "ingest_logger_csv",
    lambda t: loggers.ingest_logger_csv(logger_lines(t), logger_format(t), t.station()),
    CELLS.format(seconds=SECONDS, flag=1),
)


def hobo_lines(t):
    rows = local_readings(t).withColumn(
        "path", F.concat(F.lit("file:/hobo/"), F.col("station_id").cast("string"), F.date_format("local", "-yyyyMMdd"), F.lit(".csv"))
    )
    stamp = F.date_format("local", "MM/dd/yy hh:mm:ss a")
    data = rows.select(
        "path",
        F.concat_ws(
            ",", F.col("event_id").cast("string"), stamp, cell(1), F.lit("7.5"), cell(2), cell(3), cell(4)
        ).alias("line"),
    )
    header = F.array(
        F.concat(F.lit('"Plot Title: '), "station_code", F.lit('_north"')),
        quoted(
            F.lit("#"),
            F.lit("Date Time, GMT-06:00"),
            F.lit("CLK_Avg, n"),
            F.lit("Rainfall, mm"),
            F.lit("ERR_Avg, °C"),
            F.lit("PUR_Tot, mm"),
            F.lit("SGN_Min, m"),
        ),
    )
    files = rows.select("path", "station_code").distinct()
    return data.unionByName(files.select("path", F.explode(header).alias("line")))


def hobo_format(t):
    extra = t._literal([("Rainfall", 99, 86400)], "lookup_key string, variable_id int, seconds int")
    return logger_format(t).unionByName(extra)


register(
    "ingest_hobo_csv",
    lambda t: loggers.ingest_hobo_csv(hobo_lines(t), hobo_format(t), t.station()),
    CELLS.format(seconds=SECONDS, flag="NULL"),
)


def wide_lines(t):
    s = t.station().select(F.col("id").alias("station_id"), F.col("code").alias("station_code"), "utc_offset_minutes")
    cells = [F.max(F.when(F.col("variable_id") == v, F.col("measured").cast("string"))) for v in (1, 2, 3, 4)]
    rows = (
        t.obs()
        .groupBy("station_id", "datetime")
        .agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
        .join(s, "station_id")
    )
    offset = F.col("utc_offset_minutes")
    zone = F.concat(
        F.when(offset < 0, "-").otherwise("+"), F.lpad((F.abs(offset) / 60).cast("int").cast("string"), 2, "0"), F.lit(":00")
    )
    local = F.date_format(F.timestamp_seconds(F.unix_seconds("datetime") + offset * 60), "yyyy-MM-dd HH:mm:ss")
    stamp = F.when(F.col("station_id") % 2 == 1, local).otherwise(F.concat(local, zone))
    path = F.concat(F.lit("file:/w/wide_"), "station_code", F.lit("_2024-01.csv"))
    blank = [F.coalesce(F.col(f"c{i}"), F.lit("")) for i in range(4)]
    data = rows.select(path.alias("path"), F.concat_ws(";", stamp, *blank, F.lit("9")).alias("line"))
    header = rows.select(path.alias("path"), F.lit("datetime;CLK;ERR;PUR;SGN;ZZZ").alias("line")).distinct()
    return data.unionByName(header)


WIDE_SQL = """SELECT o.station_id, o.variable_id, m.gap AS seconds, o.datetime, o.measured, NULL AS quality_flag, false AS is_daily
    FROM obs o JOIN (SELECT station_id, CAST(gap AS INT) AS gap FROM (SELECT station_id, gap, count(*) AS n FROM (
        SELECT station_id, coalesce(CAST(epoch(datetime - lag(datetime) OVER (PARTITION BY station_id ORDER BY datetime)) AS BIGINT), 0) AS gap
        FROM (SELECT DISTINCT station_id, datetime FROM obs)) GROUP BY 1, 2)
      QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY n DESC, gap) = 1) m USING (station_id)
    WHERE variable_id < 5"""
register(
    "ingest_wide_csv",
    lambda t: loggers.ingest_wide_csv(wide_lines(t), t.variable(), t.station()),
    WIDE_SQL,
)


def daily_sheet(t):
    def value(variable, column):
        return F.max(F.when(F.col("variable_id") == variable, F.col(column).cast("string")))

    rows = (
        t.climate_daily()
        .groupBy("station_id", "day")
        .agg(
            value(6, "sum_value").alias("rainfall"),
            value(7, "max_value").alias("temp_max"),
            value(8, "min_value").alias("temp_min"),
        )
        .withColumn("month_start", F.trunc("day", "month"))
        # the sheet has rows for days that a month may not have
        .withColumn("day", (F.dayofmonth("day") + 2).cast("string"))
        .withColumn("sunshine", F.lit("TR"))
        .withColumn("total_rad", F.lit("12.5"))
    )
    rest = [c for c in sheets.DAILY_COLUMNS if c not in rows.columns]
    return rows.select("*", *[F.lit("").alias(c) for c in rest])


SHEET_VALUES = {"rainfall": "r", "temp_max": "x", "temp_min": "n", "total_rad": "12.5"}
SHEET_CELLS = ", ".join(
    f"{{'v': {v}, 'm': CAST({SHEET_VALUES.get(c, '-99.9')} AS DOUBLE)}}" for c, v in sheets.DAILY_COLUMNS.items()
)
DAILY_SQL = f"""SELECT station_id, u.v AS variable_id, 86400 AS seconds, CAST(day + 2 AS TIMESTAMP) - to_minutes(utc_offset_minutes) AS datetime,
      coalesce(CAST(u.m AS DOUBLE), -99.9) AS measured, NULL AS quality_flag, true AS is_daily
    FROM (SELECT *, unnest([{SHEET_CELLS}]) AS u
      FROM (SELECT station_id, day, max(sum_value) FILTER (variable_id = 6) AS r, max(max_value) FILTER (variable_id = 7) AS x,
          min(min_value) FILTER (variable_id = 8) AS n FROM climate_daily GROUP BY 1, 2) JOIN station s ON s.id = station_id)
    WHERE day(day) + 2 <= day(last_day(day))"""
register(
    "ingest_daily_sheet",
    lambda t: sheets.ingest_daily_sheet(daily_sheet(t), t.station()),
    DAILY_SQL,
)


def synoptic_sheet(t):
    e = F.col("event_id")
    blank = e % 11 == 0
    filled = {
        "visby": F.col("measured").cast("string"),
        "tempdb": F.lit("M"),
        "pressl": F.lit("1013.2"),
        "pastww": (e % 100).cast("string"),
        "cld1": (e % 100000).cast("string"),
    }
    columns = [*sheets.SYNOPTIC_COLUMNS, *sheets.CLOUD_GROUPS, *sheets.PAST_WEATHER]
    return local_readings(t).select(
        F.date_format("local", "yyyy-MM-dd").alias("day"),
        "station_code",
        F.hour("local").cast("string").alias("hour"),
        *[F.when(blank, "").otherwise(filled.get(c, F.lit(""))).alias(c) for c in columns],
    )


def synoptic_sql() -> str:
    known = {1000: "measured", 61: "1013.2", 1003: "CAST(substr(w, 1, 1) AS DOUBLE)", 1004: "CAST(substr(w, 2, 1) AS DOUBLE)"}
    known |= {1009: "CAST(substr(c, 2, 1) AS DOUBLE)", 1010: "CAST(substr(c, 3, 1) AS DOUBLE)", 1011: "CAST(substr(c, 4, 2) AS DOUBLE)"}
    ids = [*sheets.SYNOPTIC_COLUMNS.values()]
    for g in (sheets.CLOUD_GROUPS, sheets.PAST_WEATHER):
        ids += [v for vs in g.values() for v in vs]
    cells = ", ".join(f"{{'v': {v}, 'm': CAST({known.get(v, '-99.9')} AS DOUBLE)}}" for v in ids)
    return f"""SELECT station_id, u.v AS variable_id, 3600 AS seconds, date_trunc('hour', datetime) AS datetime, u.m AS measured, NULL AS quality_flag, false AS is_daily
      FROM (SELECT *, unnest([{cells}]) AS u FROM (SELECT *, lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') AS w,
        lpad(CAST(event_id % 100000 AS VARCHAR), 5, '0') AS c FROM readings WHERE event_id % 11 <> 0))"""


register(
    "ingest_synoptic_hourly",
    lambda t: sheets.ingest_synoptic_hourly(synoptic_sheet(t), t.station()),
    synoptic_sql(),
)
register(
    "split_coded_groups",
    lambda t: sheets.split_coded_groups(
        t.raw("orders").select(
            "o_orderkey",
            (F.col("o_orderkey") % 100000).cast("string").alias("cld1"),
            F.when(F.col("o_orderkey") % 7 == 0, "-99.9")
            .otherwise((F.col("o_orderkey") % 100).cast("string"))
            .alias("pastww"),
        ),
        ["o_orderkey"],
        ["cld1", "pastww"],
    ),
    """SELECT o_orderkey, u.v AS variable_id, u.m AS measured FROM (SELECT o_orderkey, unnest([
        {'v': 1009, 'm': CAST(substr(c, 2, 1) AS DOUBLE)}, {'v': 1010, 'm': CAST(substr(c, 3, 1) AS DOUBLE)}, {'v': 1011, 'm': CAST(substr(c, 4, 2) AS DOUBLE)},
        {'v': 1003, 'm': CASE WHEN o_orderkey % 7 = 0 THEN -99.9 ELSE CAST(substr(w, 1, 1) AS DOUBLE) END},
        {'v': 1004, 'm': CASE WHEN o_orderkey % 7 = 0 THEN -99.9 ELSE CAST(substr(w, 2, 1) AS DOUBLE) END}]) AS u
      FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0') AS c, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS w FROM orders))""",
)


def river_sheet(t):
    """All daily figures as levels: the lowest and the highest of a station and day."""
    level = t.climate_daily().groupBy("station_id", "day").agg(
        F.min("min_value").alias("low"), F.max("max_value").alias("high"), F.sum("sum_value").alias("total")
    )
    return level.select(
        "station_id",
        F.trunc("day", "month").alias("month_start"),
        F.dayofmonth("day").cast("string").alias("day"),
        F.col("low").cast("string").alias("level_6am"),
        F.when(F.col("total") % 7 == 0, "dry").otherwise(F.col("high").cast("string")).alias("level_6pm"),
    )


RIVER_ROWS = "(SELECT station_id, day, min(min_value) AS low, max(max_value) AS high, sum(sum_value) AS total FROM climate_daily GROUP BY 1, 2)"
LEVELS = f"""SELECT station_id, CAST(day AS TIMESTAMP) + INTERVAL 6 HOUR - to_minutes(s.utc_offset_minutes) AS datetime, low AS measured
    FROM {RIVER_ROWS} r JOIN station s ON s.id = station_id
  UNION ALL SELECT station_id, CAST(day AS TIMESTAMP) + INTERVAL 18 HOUR - to_minutes(s.utc_offset_minutes), high
    FROM {RIVER_ROWS} r JOIN station s ON s.id = station_id WHERE total % 7 <> 0"""
RIVER_SQL = """SELECT station_id, 4015 AS variable_id, 43200 AS seconds, datetime, measured, 1 AS quality_flag, false AS is_daily FROM flows
    UNION ALL SELECT station_id, 4016, 43200, datetime, flow, 1, false FROM flows"""
register(
    "ingest_river_sheet",
    lambda t: sheets.ingest_river_sheet(river_sheet(t), t.station(), curves(t), points(t)),
    RIVER_SQL,
    curves=CURVES,
    points=POINTS,
    levels=LEVELS,
    flows=flow_sql("levels"),
)


def dcp_messages(t):
    k = F.col("o_orderkey")
    at = F.timestamp_seconds(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k % 86400)

    def copy(signal, payload):
        header = F.concat(
            F.lpad(F.hex("o_custkey"), 8, "0"),
            F.date_format(at, "yyDDDHHmmss"),
            F.lit("G"),
            signal,
            F.lit("+0NN"),
            F.lpad((k % 300).cast("string"), 3, "0"),
            F.lit("EXE00278"),
        )
        return t.raw("orders").select(header.alias("header"), payload.alias("payload"))

    # every message arrives twice
    return copy(F.lpad((k % 90).cast("string"), 2, "0"), F.concat(F.lit("msg"), k.cast("string"))).unionByName(
        copy(F.lit("99"), F.lit("copy"))
    )


register(
    "decode_dcp_header",
    lambda t: satellite.decode_dcp_header(dcp_messages(t)),
    """SELECT printf('%08X', o_custkey) AS address, o_orderdate + to_seconds(o_orderkey % 86400) AS datetime, 'G' AS failure_code,
      lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0') AS signal_strength, '+0' AS frequency_offset, 'N' AS modulation_index, 'N' AS data_quality,
      lpad(CAST(o_orderkey % 300 AS VARCHAR), 3, '0') AS channel, 'E' AS spacecraft, 'XE' AS source, '00278' AS length, 'msg' || o_orderkey AS payload
    FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate + to_seconds(o_orderkey % 86400) ORDER BY lpad(CAST(o_orderkey % 90 AS VARCHAR), 2, '0'), channel, payload) = 1""",
)


def intervals(t):
    return t._literal([(i, i * 60) for i in range(1, 13)], "position int, seconds int")


def responses(t, separator, *lines):
    """One response per event: text before the first address, then two transmissions."""
    sent = F.timestamp_seconds(F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp"))) + 3600)
    head = F.concat("address", F.date_format(sent, "yyDDDHHmmss"), F.lit("G44+0NN117EXE00278"), F.lit(separator))
    return (
        t.raw("events")
        .withColumn("station_id", F.expr("user_id div 5").cast("int"))
        .withColumn("address", F.concat(F.lit("AB"), F.lpad(F.col("station_id").cast("string"), 6, "0")))
        .select(
            "station_id",
            "address",
            F.concat(F.lit("OK "), *[p for line in lines for p in (head, line, F.lit(separator))]).alias("response"),
        )
    )


def hhmm():
    return F.date_format(F.col("ts").cast("timestamp"), "HHmm")


def space_responses(t):
    e = F.col("event_id")
    return responses(
        t,
        " \r\n",
        F.concat_ws(" ", hhmm(), F.col("value").cast("string"), F.lit("M"), (e % 50).cast("string")),
        F.concat_ws(" ", hhmm(), *[(e % 7 + i).cast("string") for i in range(12)]),
    )


SPACE_IDS = str(satellite.SPACE_TEXT_VARIABLES)
register(
    "decode_dcp_space_text",
    lambda t: satellite.decode_dcp_space_text(space_responses(t), intervals(t)),
    f"""SELECT station_id, u.v AS variable_id, u.s AS seconds, datetime, u.m AS measured, NULL AS quality_flag, false AS is_daily FROM (
      SELECT CAST(user_id // 5 AS INT) AS station_id, date_trunc('minute', ts) AS datetime, unnest([
        {{'v': 200, 's': 60, 'm': value}}, {{'v': 16, 's': 180, 'm': CAST(event_id % 50 AS DOUBLE)}}]) AS u FROM events
      UNION ALL SELECT CAST(user_id // 5 AS INT), date_trunc('minute', ts), unnest(list_transform(range(1, 11), lambda i:
        {{'v': {SPACE_IDS}[i], 's': CAST(i * 60 AS INT), 'm': CAST(event_id % 7 + i - 1 AS DOUBLE)}})) FROM events)""",
)


def comma_responses(t):
    e = F.col("event_id")
    return responses(
        t,
        "\r\n",
        F.concat(
            F.lit("b"),
            F.concat_ws(
                ",",
                hhmm(),
                F.col("value").cast("string"),
                (e % 9).cast("string"),
                F.concat((e % 500).cast("string"), F.lit("G")),
                F.lit("xG"),
                F.concat((e % 300).cast("string"), F.lit("B")),
                (e % 700).cast("string"),
                F.lit("88"),
                F.lit(""),
            ),
        ),
    )


register(
    "decode_dcp_comma_text",
    lambda t: satellite.decode_dcp_comma_text(comma_responses(t), intervals(t)),
    """SELECT station_id, u.v AS variable_id, u.s AS seconds, datetime, u.m AS measured, NULL AS quality_flag, false AS is_daily FROM (
      SELECT CAST(user_id // 5 AS INT) AS station_id, date_trunc('minute', ts) AS datetime, unnest([
        {'v': 200, 's': 60, 'm': value}, {'v': 4007, 's': 120, 'm': CAST(event_id % 9 AS DOUBLE)}, {'v': 0, 's': 180, 'm': CAST(event_id % 500 AS DOUBLE) / 10},
        {'v': 14, 's': 300, 'm': CAST(event_id % 300 AS DOUBLE) / 10}, {'v': 30, 's': 360, 'm': CAST(event_id % 700 AS DOUBLE) / 10}]) AS u FROM events)""",
)


def encode18(value):
    raw = value.cast("bigint").bitwiseAND(F.lit(0x3FFFF).cast("bigint"))

    def six(shift):
        code = F.shiftright(raw, shift).bitwiseAND(F.lit(63).cast("bigint"))
        return F.when(code == 63, "?").otherwise(F.char(code + 64))

    return F.concat(six(12), six(6), six(0))


def binary_messages(t):
    e = F.col("event_id")
    return t.raw("events").select(
        F.expr("user_id div 5").cast("int").alias("station_id"),
        F.col("ts").cast("timestamp").alias("sent_at"),
        F.concat(
            F.lit("bB1"),
            F.char(F.lit(64) + e % 30),
            encode18(e * 13 % 131072),
            encode18(-(e % 1000) - 1),
            F.when(e % 3 == 0, "///").otherwise(encode18(e % 4096)),
            F.lit("x"),
        ).alias("payload"),
    )


def elements(t):
    return t._literal(
        [(1, 1, 10, 0, 900), (2, 2, 0, 15, 900), (3, 3, 100, 30, 1800)],
        "position int, variable_id int, divider int, minutes_back int, seconds int",
    )


register(
    "decode_pseudobinary",
    lambda t: satellite.decode_pseudobinary(binary_messages(t), elements(t), with_battery=True),
    """SELECT station_id, u.v AS variable_id, u.s AS seconds, base - to_minutes(u.b) AS datetime, u.m AS measured, NULL AS quality_flag, false AS is_daily FROM (
      SELECT CAST(user_id // 5 AS INT) AS station_id, date_trunc('minute', ts - to_minutes(event_id % 30)) AS base, unnest([
        {'v': 1, 's': 900, 'b': 0, 'm': CAST(event_id * 13 % 131072 AS DOUBLE) / 10}, {'v': 2, 's': 900, 'b': 15, 'm': CAST(-(event_id % 1000) - 1 AS DOUBLE)},
        {'v': 3, 's': 1800, 'b': 30, 'm': CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 4096 AS DOUBLE) / 100 END}]) AS u FROM events)
    WHERE u.m IS NOT NULL""",
)


def frames(events, *more):
    """Frames of the events, with further columns of them if wanted."""
    e = F.col("event_id")

    def hex_of(value, width):
        return F.lpad(F.hex(value.cast("bigint").bitwiseAND(F.lit(2**32 - 1))), width, "0")

    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    nanos = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(1_000_000)) * 1000
    lat, lon = F.lit(148000000) + e * 37 % 4400 * 10000, F.lit(-902000000) + e * 53 % 3400 * 10000
    text = F.concat(
        F.when(e % 17 == 0, "39").otherwise("38"),
        hex_of(e % 3, 2),
        hex_of(seconds, 8),
        hex_of(nanos, 8),
        hex_of(lat, 8),
        hex_of(lon, 8),
        hex_of(e % 40000 - 20000, 8),
        hex_of(e % 15000, 4),
        hex_of(e % 12 + 4, 2),
        hex_of(e % 5, 2),
        hex_of(e % 4, 2),
        hex_of(seconds - 1, 8),
        hex_of(nanos, 8),
        hex_of(e % 900, 8),
        hex_of(lat + 1000, 8),
        hex_of(lon - 1000, 8),
        hex_of(lat - 1000, 8),
        hex_of(lon + 1000, 8),
        F.lit("00"),
    )
    return events.select(*more, F.unhex(text).alias("frame"))


STROKES = """SELECT CASE WHEN event_id % 3 = 0 THEN 'CG' ELSE 'IC' END AS type, ts AS datetime, la / 1e7 AS latitude, lo / 1e7 AS longitude,
      event_id % 40000 - 20000 AS peak_current, event_id % 15000 AS ic_height, event_id % 12 + 4 AS num_sensors, event_id % 5 AS ic_multiplicity,
      event_id % 4 AS cg_multiplicity, ts - INTERVAL 1 SECOND AS start_datetime, event_id % 900 AS duration, (la + 1000) / 1e7 AS ul_latitude,
      (lo - 1000) / 1e7 AS ul_longitude, (la - 1000) / 1e7 AS lr_latitude, (lo + 1000) / 1e7 AS lr_longitude
    FROM (SELECT *, 148000000 + event_id * 37 % 4400 * 10000 AS la, -902000000 + event_id * 53 % 3400 * 10000 AS lo FROM events WHERE event_id % 17 <> 0)"""
# South, north, west, east.
AREA = (15.0, 19.0, -90.0, -87.0)
register("decode_lightning_frames", lambda t: lightning.decode_lightning_frames(frames(t.raw("events"))), STROKES)
register(
    "decode_lightning_area",
    lambda t: lightning.decode_lightning_frames(frames(t.raw("events")), area=AREA),
    STROKES + " WHERE la BETWEEN 150000000 AND 190000000 AND lo BETWEEN -900000000 AND -870000000",
)


def file_table(t):
    return t.raw("documents").select(
        F.col("doc_id").alias("id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filepath"),
        F.md5("text").alias("file_hash"),
        F.col("n_chars").alias("file_size"),
        (F.col("doc_id") % 6 + 1).cast("int").alias("status_id"),
    )


register(
    "file_manifest_dedup",
    lambda t: manifest.file_manifest_dedup(file_table(t)),
    """SELECT f.*, CASE WHEN skip THEN 'skip' ELSE 'process' END AS decision, CASE WHEN skip THEN 5 ELSE 2 END AS new_status_id FROM (
      SELECT *, EXISTS (SELECT 1 FROM files g WHERE g.file_hash = q.file_hash AND g.id <> q.id AND
          ((g.status_id IN (1, 6) AND g.id > q.id) OR g.status_id IN (2, 3))) AS skip FROM files q WHERE status_id IN (1, 6)) s
      JOIN files f USING (id)""",
    files="SELECT doc_id AS id, source || '/' || doc_id AS filepath, md5(text) AS file_hash, n_chars AS file_size, CAST(doc_id % 6 + 1 AS INT) AS status_id FROM documents",
)


# files of all formats, routed by a manifest ---------------------------------------------------

SPOILT = "station_id % 4 = 1 AND day = 13"


def sheet_lines(path, columns):
    """Lines of sheets saved as CSV: the header, one line a row, and a total at the end."""

    def run(rows):
        text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        placed = rows.withColumn("path", path)
        ends = placed.select("path").distinct()
        data = placed.select("path", text.alias("line"))
        both = ends.select("path", F.explode(F.array(F.lit(",".join(columns)), F.lit("total,,,"))).alias("line"))
        return data.unionByName(both)

    return run


def in_path(folder, *parts):
    return F.concat(F.lit(f"file:/{folder}/"), *[F.lit(p) if p in ("_", ".csv") else F.col(p).cast("string") for p in parts])


def mixed_files(t):
    """Lines (path, line) of six formats by decoder. Some logger files have a line of noise; the names of some wide files have no known station."""
    day = F.regexp_extract("path", r"(\d{2})\.\w+$", 1).try_cast("int")
    code = F.regexp_extract("path", r"ST(\d+)", 1).try_cast("int")
    toa5 = logger_lines(t).filter(code % 3 == 0)
    noise = toa5.filter((code % 4 == 1) & (day == 13)).select("path", F.lit("#!corrupt").alias("line")).distinct()
    hobo = hobo_lines(t).filter(F.regexp_extract("path", r"/(\d+)-", 1).try_cast("int") % 3 == 1)
    wide = wide_lines(t).filter(code % 3 == 2)
    stray = wide.filter(code % 5 == 0).withColumn("path", F.replace("path", F.lit("_ST"), F.lit("_XX")))
    daily = daily_sheet(t).withColumn("month", F.date_format("month_start", "yyyy-MM"))
    river = river_sheet(t).withColumn("month", F.date_format("month_start", "yyyy-MM"))
    return {
        "MANUAL DAILY": sheet_lines(in_path("daily", "station_id", "_", "month", ".csv"), ["day", "month", *sheets.DAILY_COLUMNS])(daily),
        "HYDROLOGY": sheet_lines(in_path("river", "station_id", "_", "month", ".csv"), ["day", "month", "level_6am", "level_6pm"])(river),
        "TOA5": toa5.unionByName(noise),
        "HOBO": hobo,
        "SURFACE": wide.unionByName(stray),
        "MANUAL HOURLY": sheet_lines(
            in_path("hourly", "station_code", "_", "day", ".csv"),
            ["day", "hour", "station_code", *sheets.SYNOPTIC_COLUMNS, *sheets.CLOUD_GROUPS, *sheets.PAST_WEATHER],
        )(synoptic_sheet(t)),
    }


def mixed_manifest(files):
    """A row for each file by its content; every seventh has a copy before it, some have no decoder, one is not there."""
    per_file = files.groupBy("decoder", "path").agg(F.bit_xor(F.xxhash64("line")).alias("h"), F.count("*").alias("n"))
    number = F.pmod(F.xxhash64("path"), F.lit(1 << 40))
    owner = F.regexp_extract("path", r"/(?:daily|river)/(\d+)_", 1)
    rows = per_file.select(
        number.alias("id"),
        F.col("path").alias("filepath"),
        F.when(F.col("path").like("%/hobo/%05.csv"), "SPREADSHEET").otherwise(F.col("decoder")).alias("decoder"),
        owner.try_cast("int").alias("station_id"),
        F.concat_ws("-", "path", "h", "n").alias("file_hash"),
        F.lit(1).alias("status_id"),
    )
    copies = rows.filter("filepath LIKE '%07.dat'").withColumns(
        {"id": -F.col("id") - 1, "filepath": F.concat("filepath", F.lit(".copy"))}
    )
    gone = rows.orderBy("filepath").limit(1).withColumns(
        {"id": F.lit(-1).cast("long") - (1 << 41), "filepath": F.lit("file:/in/gone.dat"), "decoder": F.lit("TOA5"), "file_hash": F.lit("gone")}
    )
    return rows.unionByName(copies).unionByName(gone)


def ingested(t):
    # one after the other, so that what one shuffles is gone before the next; those that shuffle most come first
    made = [stored(lines.select(F.lit(d).alias("decoder"), "path", "line"), "mixed-files") for d, lines in mixed_files(t).items()]
    files = functools.reduce(lambda some, more: some.unionByName(more), made)
    dims = ingest.Dimensions(t.station(), t.variable(), logger_format(t), hobo_format(t), curves(t), points(t))
    return ingest.ingest_by_decoder(stored(mixed_manifest(files), "mixed-manifest"), files.select("path", "line"), dims)


def same_file(sql: str, where: str) -> str:
    return f"""SELECT station_id, variable_id, seconds, datetime, measured, quality_flag, is_daily FROM (
      SELECT q.*, day(datetime + to_minutes(s.utc_offset_minutes)) AS day FROM ({sql}) q JOIN station s ON s.id = q.station_id) WHERE {where}"""


register(
    "ingest_by_decoder",
    lambda t: ingested(t).readings,
    " UNION ALL ".join(
        [
            same_file(CELLS.format(seconds=SECONDS, flag=1), f"station_id % 3 = 0 AND NOT ({SPOILT})"),
            same_file(CELLS.format(seconds=SECONDS, flag="NULL"), "station_id % 3 = 1 AND day <> 5"),
            same_file(WIDE_SQL, "station_id % 3 = 2"),
            DAILY_SQL,
            synoptic_sql(),
            RIVER_SQL,
        ]
    ),
    curves=CURVES,
    points=POINTS,
    levels=LEVELS,
    flows=flow_sql("levels"),
)
LOCAL = "SELECT DISTINCT station_id, s.code, CAST(datetime + to_minutes(s.utc_offset_minutes) AS DATE) AS d FROM readings JOIN station s ON s.id = station_id"
SHEETS = "SELECT DISTINCT station_id, strftime(day, '%Y-%m') AS m FROM {0}"
register(
    "file_state_after_ingest",
    lambda t: ingested(t).states.drop("id"),
    f"""SELECT path AS filepath, CASE WHEN reason IS NULL THEN 3 ELSE 4 END AS status_id,
      'Error Processing file with "' || decoder || '" decoder. ' || reason AS observation FROM (
        SELECT 'TOA5' AS decoder, 'file:/in/' || code || strftime(d, '_%Y%m%d.dat') AS path,
          CASE WHEN station_id % 4 = 1 AND day(d) = 13 THEN 'not a line of data: #!corrupt' END AS reason FROM locald WHERE station_id % 3 = 0
        UNION ALL SELECT CASE WHEN day(d) = 5 THEN 'SPREADSHEET' ELSE 'HOBO' END, 'file:/hobo/' || station_id || strftime(d, '-%Y%m%d.csv'),
          CASE WHEN day(d) = 5 THEN 'unknown decoder' END FROM locald WHERE station_id % 3 = 1
        UNION ALL SELECT DISTINCT 'SURFACE', 'file:/w/wide_' || code || '_2024-01.csv', NULL FROM locald WHERE station_id % 3 = 2
        UNION ALL SELECT DISTINCT 'SURFACE', 'file:/w/wide_XX' || substr(code, 3) || '_2024-01.csv', 'unknown station XX' || substr(code, 3)
          FROM locald WHERE station_id % 3 = 2 AND station_id % 5 = 0
        UNION ALL SELECT 'MANUAL DAILY', 'file:/daily/' || station_id || '_' || m || '.csv', NULL FROM ({SHEETS.format('climate_daily')})
        UNION ALL SELECT 'HYDROLOGY', 'file:/river/' || station_id || '_' || m || '.csv', NULL FROM ({SHEETS.format('climate_daily')})
        UNION ALL SELECT 'MANUAL HOURLY', 'file:/hourly/' || code || '_' || d || '.csv', NULL FROM locald
        UNION ALL SELECT 'TOA5', 'file:/in/gone.dat', 'no such file, or an empty one')
    UNION ALL SELECT 'file:/in/' || code || strftime(d, '_%Y%m%d.dat.copy'), 5, NULL FROM locald WHERE station_id % 3 = 0 AND day(d) = 7""",
    locald=LOCAL,
)
