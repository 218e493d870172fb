"""Streaming jobs run over the events file until it is read through."""

from pyspark.sql import functions as F

from checks.base import AGG, VALID
from checks.decoders import AREA, frames, logger_format, logger_lines
from checks.quality import TESTS
from checks.registry import register
from checks.summaries import ASOF
from pluvio import schema
from pluvio.session import shared_dir
from pluvio.sources.tables import event_readings, latest_per_key
from pluvio.streaming import jobs
from pluvio.streaming.store import Arrivals, Store

NOW = {"availableNow": True}


def events(t):
    return (
        t.spark.readStream.schema(schema.EVENTS).option("pathGlobFilter", "events.parquet").parquet(t.dir)
    )


def new_store(t, purpose):
    root = shared_dir(t.spark, purpose)
    # the given tables are small: a day is one folder
    return Store(t.spark, root, schema.OBS, buckets=1), f"{root}/checkpoint"


def recomputed(t, table):
    store, checkpoint = new_store(t, "recompute")
    jobs.stream_dirty_recompute(
        event_readings(events(t)), store, t.station(), checkpoint, NOW, latest_per_key
    ).awaitTermination()
    return store.table(table)


register("stream_dirty_recompute", lambda t: recomputed(t, "hourly"), "SELECT * FROM hourly")
register("stream_dirty_recompute_daily", lambda t: recomputed(t, "daily"), "SELECT * FROM daily")


def last24h(t):
    store, checkpoint = new_store(t, "last24h")
    out = f"{store.root}/last24h"
    jobs.stream_last24h(
        event_readings(events(t)), store, lambda: ASOF, out, checkpoint, NOW, latest_per_key
    ).awaitTermination()
    return t.spark.read.parquet(out)


register("stream_last24h", last24h, "SELECT * FROM last24")


def newest_first(t, rows, by, run):
    """``rows`` written in three parts, the last by ``by`` first; the stream is run to its end after each of them."""
    folder, by = shared_dir(t.spark, "late"), F.expr(by)
    first, last = rows.agg(F.min(by), F.max(by)).first()
    for k in (2, 1, 0):
        low, high = (first + (last + 1 - first) * j // 3 for j in (k, k + 1))
        rows.filter((by >= low) & (by < high)).write.mode("append").parquet(folder)
        run(t.spark.readStream.schema(rows.schema).parquet(folder))


MICROS = "unix_micros(cast(ts AS timestamp))"


def hourly_window(t, late):
    store, checkpoint = new_store(t, "hourly-window")

    def run(rows):
        jobs.stream_hourly_window(event_readings(rows), store, checkpoint, NOW).awaitTermination()

    newest_first(t, t.raw("events"), MICROS, run) if late else run(events(t))
    return store.table("hourly")


HOURLY = f"SELECT date_trunc('hour', tt) AS datetime, station_id, variable_id, is_daily, {AGG} FROM shifted GROUP BY 1, 2, 3, 4"
SHIFTED = f"""SELECT *, CASE WHEN NOT is_daily AND datetime = date_trunc('day', datetime) THEN datetime - INTERVAL 1 SECOND ELSE datetime END AS tt
      FROM (SELECT *, coalesce(consisted, measured) AS v FROM readings) WHERE {VALID}"""
register("stream_hourly_window", lambda t: hourly_window(t, late=False), HOURLY, shifted=SHIFTED)
register("stream_hourly_late", lambda t: hourly_window(t, late=True), HOURLY, shifted=SHIFTED)


def dedup(t, late):
    root = shared_dir(t.spark, "dedup")
    out = Arrivals(t.spark, f"{root}/out", schema.OBS)

    def run(rows):
        jobs.stream_dedup(event_readings(rows).drop("event_id"), out, f"{root}/checkpoint", NOW).awaitTermination()

    newest_first(t, t.raw("events"), MICROS, run) if late else run(events(t))
    return out.table().select(*schema.KEY)


KEYS = "SELECT DISTINCT station_id, variable_id, datetime FROM readings"
register("stream_dedup", lambda t: dedup(t, late=False), KEYS)
register("stream_dedup_late", lambda t: dedup(t, late=True), KEYS)


def captures(t):
    """Capture files of up to 1,000 frames; every fifth file comes a second time, under another name and much earlier."""
    e = t.raw("events")
    framed = frames(e, "event_id").withColumn("file", F.expr("event_id div 1000"))
    files = framed.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("event_id", "frame"))).alias("f")).select(
        F.concat(F.lit("capture-"), F.col("file").cast("string"), F.lit(".bin")).alias("path"),
        F.unhex(F.array_join(F.transform("f", lambda x: F.hex(x["frame"])), "")).alias("content"),
        "file",
    )
    again = files.filter("file % 5 = 0").withColumns(
        {"path": F.concat(F.lit("again-"), "path"), "file": -F.col("file") - 1}
    )
    return files.unionByName(again)


def lightning_counts(t, area, late):
    store, checkpoint = new_store(t, "lightning")

    def run(files):
        jobs.stream_lightning(files, store, checkpoint, NOW, area=area).awaitTermination()

    if late:
        newest_first(t, captures(t), "file", run)
    else:
        folder = shared_dir(t.spark, "captures")
        captures(t).write.parquet(folder)
        run(t.spark.readStream.schema("path string, content binary").parquet(folder))
    return store.table("strokes")


COUNTS = "SELECT date_trunc('hour', ts) AS window_start, type, count(*) AS strokes, max(peak) AS strongest FROM strokes GROUP BY 1, 2"
STROKES = """SELECT CASE WHEN event_id % 3 = 0 THEN 'CG' ELSE 'IC' END AS type, ts, abs(event_id % 40000 - 20000) AS peak, la, lo
  FROM (SELECT *, 148000000 + event_id * 37 % 4400 * 10000 AS la, -902000000 + event_id * 53 % 3400 * 10000 AS lo FROM events WHERE event_id % 17 <> 0)"""
INSIDE = STROKES + " WHERE la BETWEEN 150000000 AND 190000000 AND lo BETWEEN -900000000 AND -870000000"
register("stream_lightning", lambda t: lightning_counts(t, AREA, late=False), COUNTS, strokes=INSIDE)
register("stream_lightning_late", lambda t: lightning_counts(t, None, late=True), COUNTS, strokes=STROKES)
register("stream_lightning_area_late", lambda t: lightning_counts(t, AREA, late=True), COUNTS, strokes=INSIDE)


def file_ingest(t):
    """Writes the logger files, a path and a line a row, then ingests the folder."""
    store, checkpoint = new_store(t, "file-ingest")
    folder = f"{store.root}/incoming"
    # a logger file for every (station, day) is far too small to be a file of its own here
    logger_lines(t).select("path", "line").write.parquet(folder)
    incoming = t.spark.readStream.schema("path string, line string").parquet(folder)
    jobs.stream_file_ingest(
        incoming,
        store,
        logger_format(t),
        t.station(),
        t.variable(),
        t.range_thr(),
        t.step_thr(),
        checkpoint,
        NOW,
    ).awaitTermination()
    return store.table("obs").select(*schema.KEY, "measured", "is_daily", "quality_flag")


FILE_KEYS = """SELECT station_id, variable_id, CAST(CASE variable_id WHEN 1 THEN 3600 WHEN 2 THEN 600 WHEN 3 THEN 300 ELSE 60 END AS INT) AS seconds,
      datetime, max(measured) AS measured, false AS is_daily
    FROM readings WHERE variable_id < 5 AND event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1, 2, 3, 4"""
register(
    "stream_file_ingest",
    file_ingest,
    "SELECT station_id, variable_id, datetime, measured, is_daily, flag2 AS quality_flag FROM bothq",
    **{**TESTS, "obs_regular": FILE_KEYS},
)
