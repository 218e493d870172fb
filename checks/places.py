"""Spatial, signal, prediction, rating curves."""

from pyspark.sql import functions as F

from checks.base import r2
from checks.registry import register
from checks.summaries import daily
from pluvio.operators import rating, signal, spatial, write

WEST, SOUTH, EAST, NORTH = -90.0, 15.0, -87.0, 19.0


def curves(t):
    starts = ["1996-01-01", "1999-01-01", "2023-12-20", "2024-01-10", "2024-01-20"]
    return t.station().select(
        F.col("id").alias("station_id"),
        F.posexplode(F.array(*[F.lit(s).cast("timestamp") for s in starts])).alias("i", "start_date"),
    ).select((F.col("station_id") * 10 + F.col("i")).alias("id"), "station_id", "start_date")


def points(t):
    return (
        curves(t)
        .select("id", "station_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("j"))
        .select(
            F.col("id").alias("rating_curve_id"),
            (F.col("j") * 5).cast("double").alias("h"),
            ((F.col("id") % 10 + 1) * F.col("j") * 5 + F.col("station_id") % 7).cast("double").alias("q"),
        )
    )


CURVES = """SELECT id * 10 + CAST(i AS INT) AS id, id AS station_id, ['1996-01-01', '1999-01-01', '2023-12-20', '2024-01-10', '2024-01-20'][i + 1]::TIMESTAMP AS start_date
  FROM station, range(5) r(i)"""
POINTS = """SELECT id AS rating_curve_id, CAST(j * 5 AS DOUBLE) AS h, CAST((id % 10 + 1) * j * 5 + station_id % 7 AS DOUBLE) AS q FROM curves, range(1, 9) r(j)"""
ASOF_SQL = """SELECT o.*, (SELECT arg_max(c.id, c.start_date) FROM curves c WHERE c.station_id = o.station_id AND c.start_date < o.datetime) AS curve_id FROM obs o"""


def flow_sql(levels: str) -> str:
    return f"""SELECT station_id, datetime, measured, CASE WHEN measured = -99.9 THEN -99.9 ELSE coalesce(
        (SELECT q FROM points p WHERE p.rating_curve_id = o.curve_id AND p.h = o.measured),
        (SELECT (n.q - b.q) / (n.h - b.h) * (o.measured - b.h) + b.q FROM points b JOIN points n ON n.rating_curve_id = b.rating_curve_id AND n.h = b.h + 5
          WHERE b.rating_curve_id = o.curve_id AND b.h < o.measured AND n.h > o.measured), -99.9) END AS flow
      FROM (SELECT l.*, (SELECT arg_max(c.id, c.start_date) FROM curves c WHERE c.station_id = l.station_id AND c.start_date < l.datetime) AS curve_id FROM {levels} l) o"""


RATING = dict(curves=CURVES, points=POINTS)
register(
    "latest_curve_asof",
    lambda t: rating.latest_curve_asof(t.obs().select("station_id", "variable_id", "datetime", "measured"), curves(t)),
    "SELECT station_id, variable_id, datetime, measured, curve_id FROM asof_q",
    asof_q=ASOF_SQL,
    **RATING,
)
register(
    "rating_curve_flow",
    lambda t: rating.rating_curve_flow(t.obs().select("station_id", "datetime", "measured"), curves(t), points(t)),
    flow_sql("(SELECT station_id, datetime, measured FROM obs)"),
    **RATING,
)


def flash_points(t):
    e = F.col("event_id")
    return t.raw("events").select(
        "event_id",
        ((F.lit(-90200) + e * 53 % 3400).cast("double") / 1000 + 0.0005).alias("longitude"),
        ((F.lit(14800) + e * 37 % 4400).cast("double") / 1000 + 0.0005).alias("latitude"),
    )


FLASH = """SELECT event_id, CAST(-90200 + event_id * 53 % 3400 AS DOUBLE) / 1000 + 0.0005 AS longitude,
  CAST(14800 + event_id * 37 % 4400 AS DOUBLE) / 1000 + 0.0005 AS latitude FROM events"""


def polygons(t):
    """One area per nation: boxes, boxes with a hole, and triangles."""
    n = F.col("n_nationkey")
    x0 = (F.lit(-900) + n % 5 * 6).cast("double") / 10
    y0 = (F.lit(150) + F.floor(n / 5) * 8).cast("double") / 10

    def ring(*corners):
        pts = [F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y")) for dx, dy in (*corners, corners[0])]
        return F.array(*pts)

    box = ring((0.0, 0.0), (0.5, 0.0), (0.5, 0.7), (0.0, 0.7))
    hole = ring((0.2, 0.3), (0.3, 0.3), (0.3, 0.5), (0.2, 0.5))
    triangle = ring((0.0, 0.0), (0.5, 0.0), (0.0, 0.7))
    return t.raw("nation").select(
        F.col("n_name").alias("name"),
        F.when(n % 5 == 4, F.array(triangle)).when(n % 2 == 0, F.array(box, hole)).otherwise(F.array(box)).alias("rings"),
    )


register(
    "point_in_polygon",
    lambda t: spatial.point_in_polygon(flash_points(t), polygons(t), "watershed", 0.5),
    """SELECT f.*, coalesce((SELECT n_name FROM (SELECT n_nationkey AS n, n_name, CAST(-900 + n_nationkey % 5 * 6 AS DOUBLE) / 10 AS x0,
          CAST(150 + n_nationkey // 5 * 8 AS DOUBLE) / 10 AS y0 FROM nation)
        WHERE f.longitude > x0 AND f.longitude < x0 + 0.5 AND f.latitude > y0 AND f.latitude < y0 + 0.7
          AND CASE WHEN n % 5 = 4 THEN (f.longitude - x0) / 0.5 + (f.latitude - y0) / 0.7 < 1
            WHEN n % 2 = 0 THEN NOT (f.longitude > x0 + 0.2 AND f.longitude < x0 + 0.3 AND f.latitude > y0 + 0.3 AND f.latitude < y0 + 0.5)
            ELSE true END), 'NOT FOUND') AS watershed FROM flash_points f""",
    flash_points=FLASH,
)


def raster(t):
    p = F.col("p_partkey")
    return t.raw("part").select(
        F.floor(p / 60).cast("int").alias("row"), (p % 60).cast("int").alias("col"), (F.col("p_size") * 10).alias("elevation")
    )


register(
    "grid_altitude_lookup",
    lambda t: spatial.grid_altitude_lookup(flash_points(t), raster(t), WEST, NORTH, 0.05),
    """SELECT f.*, coalesce(p_size * 10, -999) AS elevation FROM flash_points f LEFT JOIN part
      ON p_partkey // 60 = floor((CAST(19 AS DOUBLE) - f.latitude) / CAST(0.05 AS DOUBLE)) AND p_partkey % 60 = floor((f.longitude - CAST(-90 AS DOUBLE)) / CAST(0.05 AS DOUBLE))""",
    flash_points=FLASH,
)


def day_points(t):
    places = t.station().select(F.col("id").alias("station_id"), "longitude", "latitude")
    return (
        daily(t)
        .join(places, "station_id")
        .select("variable_id", "day", "is_daily", "station_id", "longitude", "latitude", F.col("max_value").alias("value"))
    )


BY = ["variable_id", "day", "is_daily"]
DAYPTS = """SELECT variable_id, day, is_daily, station_id, longitude, latitude, max_value AS value FROM daily JOIN station s ON s.id = station_id"""
CLEAN = """SELECT * FROM daypts QUALIFY row_number() OVER (PARTITION BY variable_id, day, is_daily, longitude, latitude ORDER BY station_id) = 1"""
register("clean_points", lambda t: spatial.clean_points(day_points(t), BY), "SELECT * FROM cleanpts", daypts=DAYPTS, cleanpts=CLEAN)


def grid(t):
    return spatial.cressman_grid(
        spatial.clean_points(day_points(t), BY), BY, WEST, SOUTH, EAST, NORTH, hres=0.25, radius=0.7, minimum_neighbors=2
    )


DX, DY = "(CAST(3 AS DOUBLE) / 11)", "(CAST(4 AS DOUBLE) / 15)"
NODES = f"""SELECT CAST(x AS INT) AS gx, CAST(y AS INT) AS gy, CAST(-90 AS DOUBLE) + x * {DX} AS lon, CAST(15 AS DOUBLE) + y * {DY} AS lat FROM range(12) a(x), range(16) b(y)"""
CRESS = """SELECT variable_id, day, is_daily, gx, gy, lon AS longitude, lat AS latitude, sum((0.7::DOUBLE * 0.7::DOUBLE - d2) / (0.7::DOUBLE * 0.7::DOUBLE + d2) * value) / sum((0.7::DOUBLE * 0.7::DOUBLE - d2) / (0.7::DOUBLE * 0.7::DOUBLE + d2)) AS value, count(*) AS neighbors
  FROM (SELECT *, (lon - longitude) * (lon - longitude) + (lat - latitude) * (lat - latitude) AS d2 FROM cleanpts, nodes)
  WHERE d2 <= 0.7::DOUBLE * 0.7::DOUBLE GROUP BY 1, 2, 3, 4, 5, 6, 7 HAVING count(*) >= 2"""
GRID = dict(daypts=DAYPTS, cleanpts=CLEAN, nodes=NODES, cress=CRESS)


def rounded(df, *columns, digits=6):
    from pluvio.functions.columns import round_half_up

    return df.withColumns({c: round_half_up(c, digits) for c in columns})


register(
    "cressman_grid",
    lambda t: rounded(grid(t), "value", "longitude", "latitude"),
    f"SELECT variable_id, day, is_daily, gx, gy, {r2('longitude', 6)} AS longitude, {r2('latitude', 6)} AS latitude, {r2('value', 6)} AS value, neighbors FROM cress",
    **GRID,
)
register(
    "cressman_dense_grid",
    lambda t: rounded(spatial.dense_grid(grid(t), BY, WEST, SOUTH, EAST, NORTH, 0.25), "value"),
    f"""SELECT s.variable_id, s.day, s.is_daily, n.gx, n.gy, {r2('c.value', 6)} AS value FROM (SELECT DISTINCT variable_id, day, is_daily FROM cress) s CROSS JOIN nodes n
      LEFT JOIN cress c ON c.variable_id = s.variable_id AND c.day = s.day AND c.is_daily = s.is_daily AND c.gx = n.gx AND c.gy = n.gy""",
    **GRID,
)
register(
    "contour_levels",
    lambda t: spatial.contour_levels(spatial.clean_points(day_points(t), BY), BY).select(
        *BY, F.concat_ws(",", F.transform("levels", lambda x: x.cast("string"))).alias("levels")
    ),
    """SELECT variable_id, day, is_daily, array_to_string(range(CAST(trunc(min(value)) AS BIGINT) - 1, CAST(trunc(max(value)) AS BIGINT) + 1), ',') AS levels
    FROM cleanpts GROUP BY 1, 2, 3""",
    daypts=DAYPTS,
    cleanpts=CLEAN,
)

HFW = """SELECT *, TIMESTAMP '2024-01-15 12:00:00' + to_seconds(CAST(ceil(epoch(datetime - TIMESTAMP '2024-01-15 12:00:00') / {s}) * {s} AS BIGINT)) AS window_end FROM hf"""
STATS = f"""SELECT station_id, variable_id, window_end AS datetime, unnest(['Sea Level [MIN]', 'Sea Level [MAX]', 'Sea Level [AVG]', 'Sea Level [STDV]', 'Significant Wave Height']) AS name,
    unnest([lo, hi, mean, dev, dev * 4]) AS measured FROM (SELECT station_id, variable_id, window_end, min(measured) AS lo, max(measured) AS hi,
      avg(measured) AS mean, stddev_pop(measured) AS dev FROM hfw GROUP BY 1, 2, 3)"""


def dft_sql(top: int) -> str:
    return f"""SELECT station_id, variable_id, window_end AS datetime, CAST(row_number() OVER (PARTITION BY station_id, variable_id, window_end ORDER BY amp DESC) AS INT) AS component,
      k / CAST(cnt AS DOUBLE) AS frequency, amp AS amplitude, d - 360 * floor(d / 360) AS phase FROM (
        SELECT *, 2 * sqrt(re * re + im * im) / cnt AS amp, degrees(atan2(im, re) + pi() / 2) AS d FROM (
          SELECT station_id, variable_id, window_end, cnt, k, sum(x * cos(2 * pi() * (k * n % cnt) / cnt)) AS re, -sum(x * sin(2 * pi() * (k * n % cnt) / cnt)) AS im
          FROM (SELECT *, measured - avg(measured) OVER w AS x, row_number() OVER (w ORDER BY datetime) - 1 AS n, count(*) OVER w AS cnt
              FROM hfw WINDOW w AS (PARTITION BY station_id, variable_id, window_end)), range(1, 541) r(k)
          WHERE k <= 0.3 * cnt GROUP BY 1, 2, 3, 4, 5)) WHERE amp >= 0.01
    QUALIFY row_number() OVER (PARTITION BY station_id, variable_id, window_end ORDER BY amp DESC) <= {top}"""


START = "2024-01-15 12:00:00"
register(
    "hf_window_stats",
    lambda t: rounded(signal.hf_window_stats(signal.in_windows(t.hf(), 30, START)), "measured"),
    f"SELECT * REPLACE ({r2('measured', 6)} AS measured) FROM stats",
    hfw=HFW.format(s=1800),
    stats=STATS,
)
register(
    "wave_components",
    lambda t: rounded(
        signal.wave_components(signal.in_windows(t.hf(), 30, START)), "frequency", "amplitude", "phase", digits=5
    ),
    f"SELECT * REPLACE ({r2('frequency', 5)} AS frequency, {r2('amplitude', 5)} AS amplitude, {r2('phase', 5)} AS phase) FROM waves",
    hfw=HFW.format(s=1800),
    waves=dft_sql(5),
)
register(
    "wave_windows",
    lambda t: rounded(signal.wave_windows(t.hf(), 10, 3, START), "measured", digits=5),
    f"""SELECT station_id, variable_id, datetime, name, {r2('measured', 5)} AS measured FROM (SELECT * FROM stats UNION ALL
      SELECT station_id, variable_id, datetime, 'Wave Component ' || component || unnest([' Frequency', ' Amplitude', ' Phase']), unnest([frequency, amplitude, phase]) FROM waves)""",
    hfw=HFW.format(s=600),
    stats=STATS,
    waves=dft_sql(3),
)


LATE_HF = "minute(datetime) BETWEEN 7 AND 8 OR station_id % 2 = 1 AND datetime = TIMESTAMP '2024-01-15 12:20:00'"


def hf_refreshed(t):
    """Summaries of 10-minute windows without the late readings, brought up to date."""
    late = t.hf().filter(LATE_HF)
    before = signal.wave_windows(t.hf().filter(f"NOT ({LATE_HF})"), 10, 3, START).withColumn("minutes", F.lit(10))
    return signal.hf_refresh(t.hf(), write.dirty_hf_ranges(late), before, [10], 3, START).drop("minutes")


register(
    "hf_refresh",
    lambda t: rounded(hf_refreshed(t), "measured", digits=5),
    f"""SELECT station_id, variable_id, datetime, name, {r2('measured', 5)} AS measured FROM (SELECT * FROM stats UNION ALL
      SELECT station_id, variable_id, datetime, 'Wave Component ' || component || unnest([' Frequency', ' Amplitude', ' Phase']), unnest([frequency, amplitude, phase]) FROM waves)""",
    hfw=HFW.format(s=600),
    stats=STATS,
    waves=dft_sql(3),
)
register(
    "hf_touched_windows",
    lambda t: signal.touched_windows(write.dirty_hf_ranges(t.hf().filter(LATE_HF)), 5, START),
    f"""SELECT DISTINCT station_id, variable_id, w AS window_end FROM (
      SELECT station_id, variable_id, min(datetime) AS a, max(datetime) AS b FROM hf WHERE {LATE_HF} GROUP BY 1, 2),
      unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{START}' + INTERVAL 2 HOUR, INTERVAL 5 MINUTE)) AS g(w)
    WHERE w >= a AND w - INTERVAL 5 MINUTE < b""",
)


def neighbourhood(t):
    return t.station().select(
        F.concat(F.lit("N"), F.floor(F.col("id") / 3).cast("string")).alias("name"), F.col("id").alias("station_id")
    )


register(
    "neighbourhood_features",
    lambda t: signal.neighbourhood_features(t.obs_regular(), neighbourhood(t), 60, 180).select(
        "name",
        "variable_id",
        "datetime",
        "avg",
        F.concat_ws(
            ";", F.transform("stations", lambda s: F.concat_ws("=", s.station_id.cast("string"), s.acc.cast("string")))
        ).alias("stations"),
    ),
    """SELECT name, variable_id, datetime, sum(acc) / count(*) AS avg, string_agg(station_id || '=' || acc, ';' ORDER BY station_id) AS stations
    FROM acc3 JOIN nbh USING (station_id) GROUP BY 1, 2, 3 HAVING count(*) = any_value(size)""",
    nbh="SELECT 'N' || (id // 3) AS name, id AS station_id, count(*) OVER (PARTITION BY id // 3) AS size FROM station",
    acc3="""SELECT datetime, station_id, variable_id, acc FROM (
      SELECT *, sum(measured) OVER (PARTITION BY station_id, variable_id ORDER BY datetime ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS acc,
        lag(datetime, 2) OVER (PARTITION BY station_id, variable_id ORDER BY datetime) AS earliest
      FROM obs_regular WHERE measured <> -99.9) WHERE datetime - earliest < INTERVAL 180 MINUTE""",
)


def predictions(t):
    return t.obs().select(
        "station_id", "variable_id", "datetime", (F.col("quality_flag") % 4).cast("string").alias("prediction_result")
    )


def mapping(t):
    return t.flag().filter("id <> 3").select(
        (F.col("id") % 4).cast("string").alias("prediction_result"), (F.lit(5) - F.col("id")).alias("quality_flag_id")
    )


register(
    "apply_prediction_labels",
    lambda t: signal.apply_prediction_labels(t.obs(), predictions(t), mapping(t))[0],
    "SELECT * REPLACE (CASE WHEN quality_flag = 3 THEN ml_flag ELSE 5 - quality_flag END AS ml_flag) FROM obs",
)
register(
    "apply_prediction_errors",
    lambda t: signal.apply_prediction_labels(t.obs(), predictions(t), mapping(t))[1],
    "SELECT station_id, variable_id, datetime, '3' AS prediction_result FROM obs WHERE quality_flag = 3",
)
