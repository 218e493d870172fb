"""Streams end in the tables of the batch operators, also with late and repeated data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.compare import _norm
from pluvio import schema
from pluvio.operators import summary, write
from pluvio.sources.lightning import decode_lightning_frames
from pluvio.streaming import jobs
from pluvio.streaming import store as store_module
from pluvio.streaming.store import Arrivals, Store
from tests.test_decoders import frame

NOW = {"availableNow": True}


def same(a, b):
    columns = sorted(a.columns)
    rows = [sorted((tuple(_norm(x) for x in r) for r in df.select(columns).collect()), key=repr) for df in (a, b)]
    return rows[0] == rows[1]


def one_per_key(df):
    return df.dropDuplicates(schema.KEY)


def test_late_files(spark, tables, tmp_path):
    """Three files; the last one is older than the others and must still reach its hours and days."""
    obs = tables.obs().persist()
    t = F.col("datetime")
    parts = [
        (t >= F.lit("2024-01-10").cast("timestamp")) & (t < F.lit("2024-01-20").cast("timestamp")),
        t >= F.lit("2024-01-20").cast("timestamp"),
        t < F.lit("2024-01-10").cast("timestamp"),
    ]
    store = Store(spark, str(tmp_path / "store"), schema.OBS)
    for part in parts:
        obs.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(obs.schema).parquet(str(tmp_path / "in"))
        jobs.stream_dirty_recompute(
            stream, store, tables.station(), str(tmp_path / "cp"), NOW, one_per_key
        ).awaitTermination()
    assert same(store.table("hourly"), summary.hourly_summary(obs))
    assert same(store.table("daily"), summary.daily_summary(obs, tables.station()))
    obs.unpersist()


def test_replayed_batch_changes_nothing(spark, tables, tmp_path):
    store = Store(spark, str(tmp_path / "store"), schema.OBS)
    batch = tables.obs().filter(F.col("datetime") < F.lit("2024-01-04").cast("timestamp"))
    for _ in range(2):
        store.merge_obs(batch, 0)
        store.recompute(batch, tables.station(), 0)
    cleared = write.upsert_override(batch.limit(0), batch)
    assert same(store.table("obs"), cleared)
    assert same(store.table("hourly"), summary.hourly_summary(cleared))


def test_only_touched_days_are_read(spark, tables, tmp_path):
    """A day between two touched ones is neither listed nor read, and only the last two versions stay."""
    store = Store(spark, str(tmp_path / "store"), schema.OBS, buckets=2)
    obs = one_per_key(tables.obs()).persist()
    store.merge_obs(obs, 0)
    touched = obs.filter("to_date(datetime) IN (DATE'2024-01-05', DATE'2024-01-07')")
    places = store.places("obs", touched)
    found = store.at("obs", places)
    assert {str(r.part) for r in found.select("part").distinct().collect()} == {"2024-01-05", "2024-01-07"}
    assert not [f for f in found.inputFiles() if "2024-01-06" in f]
    assert store.at("obs", []).isEmpty()
    for token in (1, 2, 3):
        store.merge_obs(touched.withColumn("measured", F.lit(float(token))), token)
    folders = {f.name for f in (tmp_path / "store" / "obs" / "part=2024-01-05" / "bucket=0").iterdir() if f.is_dir()}
    assert folders == {"version=3", "version=4"}
    assert {f.name for f in (tmp_path / "store" / "obs" / "part=2024-01-06" / "bucket=0").iterdir() if f.is_dir()} == {"version=1"}
    assert store.table("obs").count() == obs.count()
    assert store.table("obs").filter("measured = 3.0 AND day(datetime) IN (5, 7)").count() == touched.count()
    obs.unpersist()


def test_log_is_written_anew(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "LOG_COMMITS", 3)
    store = Store(spark, str(tmp_path / "store"), schema.OBS, buckets=1)
    obs = one_per_key(tables.obs()).persist()
    for token in range(7):
        store.merge_obs(obs.filter(F.dayofmonth("datetime") == 1 + token % 4), token)
    assert sorted(f.name for f in (tmp_path / "store" / "obs_log").iterdir() if f.is_dir()) == ["at=6", "at=7"]
    assert store.table("obs").count() == obs.filter(F.dayofmonth("datetime") <= 4).count()
    store.merge_obs(obs, 6)  # applied already
    assert store.table("obs").count() == obs.filter(F.dayofmonth("datetime") <= 4).count()
    obs.unpersist()


def test_a_failed_batch_is_not_seen(spark, tables, tmp_path, monkeypatch):
    """Written but not committed: readers see the old rows, and the batch can be run again."""
    store = Store(spark, str(tmp_path / "store"), schema.OBS, buckets=1)
    obs = one_per_key(tables.obs()).filter(F.dayofmonth("datetime") <= 3).persist()
    store.merge_obs(obs, 0)
    changed = obs.withColumn("measured", F.lit(7.0))
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge_obs(changed, 1)
    assert same(store.table("obs").select("measured"), obs.select("measured"))
    store.merge_obs(changed, 1)
    assert store.table("obs").filter("measured <> 7.0").isEmpty()
    assert store.table("obs").count() == obs.count()
    obs.unpersist()


def in_files(spark, rows, tmp_path, run):
    """Three files, the newest first, the last of them with rows of the first again."""
    t = F.col("datetime")
    cut = [F.lit(f"2024-01-{d}").cast("timestamp") for d in (10, 20)]
    folder = str(tmp_path / "in")
    for part in (t >= cut[1], (t >= cut[0]) & (t < cut[1]), (t < cut[0]) | (t >= cut[1])):
        rows.filter(part).coalesce(1).write.mode("append").parquet(folder)
        run(spark.readStream.schema(rows.schema).parquet(folder))


def test_first_arrivals_of_late_files(spark, tables, tmp_path):
    obs = tables.event_readings().drop("event_id").persist()
    out = Arrivals(spark, str(tmp_path / "out"), schema.OBS)
    in_files(spark, obs, tmp_path, lambda s: jobs.stream_dedup(s, out, str(tmp_path / "cp"), NOW).awaitTermination())
    assert same(out.table().select(*schema.KEY), obs.select(*schema.KEY).distinct())
    obs.unpersist()


def test_a_batch_of_arrivals_run_again(spark, tables, tmp_path):
    obs = one_per_key(tables.obs()).filter(F.dayofmonth("datetime") <= 3)
    out = Arrivals(spark, str(tmp_path / "out"), schema.OBS)
    for _ in range(2):
        out.add(obs, "a-0")
    assert out.table().count() == obs.count()
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    assert out.others(days, "a-0").isEmpty()
    assert out.others(days, "a-1").count() == obs.filter(F.dayofmonth("datetime") <= 2).count()


def test_hours_of_late_files(spark, tables, tmp_path):
    """Every row counts once for each file it is in."""
    obs = tables.obs().persist()
    store = Store(spark, str(tmp_path / "store"), schema.OBS)
    in_files(spark, obs, tmp_path, lambda s: jobs.stream_hourly_window(s, store, str(tmp_path / "cp"), NOW).awaitTermination())
    twice = obs.unionByName(obs.filter(F.col("datetime") >= F.lit("2024-01-20").cast("timestamp")))
    assert same(store.table("hourly"), summary.hourly_summary(twice))
    obs.unpersist()


def test_capture_files_count_once(spark, tmp_path):
    """Files of one content count once, in one batch or in two; keep-alive frames and cut ones don't."""
    store = Store(spark, str(tmp_path / "store"), schema.OBS)

    def run(folder):
        files = jobs.capture_stream(spark, folder)
        jobs.stream_lightning(files, store, str(tmp_path / "cp"), NOW).awaitTermination()
        return {(r.window_start, r.type): r.strokes for r in store.table("strokes").collect()}

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.bin").write_bytes(frame() * 3 + frame(kind=0x39) + b"cut")
    (folder / "a-copy.bin").write_bytes(frame() * 3 + frame(kind=0x39) + b"cut")
    (folder / "empty.bin").write_bytes(b"")
    hour = dt.datetime(2024, 1, 15, 12)
    assert list(run(str(folder)).values()) == [3]
    (folder / "a-again.bin").write_bytes(frame() * 3 + frame(kind=0x39) + b"cut")
    (folder / "b.bin").write_bytes(frame() * 2)
    found = run(str(folder))
    assert list(found.values()) == [5] and {w for w, _ in found} == {hour}
    assert store.table("files").count() == 2  # Spark passes over files without bytes


def test_flags_do_not_depend_on_batches(spark, tmp_path):
    """Files in two batches, some late, get the step flags of all files at once."""
    station = spark.createDataFrame([(1, "ST", 0, None, True)], "id int, code string, utc_offset_minutes int, reference_station_id int, is_automatic boolean")
    variable = spark.createDataFrame(
        [(1, "A", 0.0, 60.0, 5.0, "Numeric")],
        "id int, symbol string, range_min_hourly double, range_max_hourly double, step_hourly double, variable_type string",
    ).withColumns({c: F.lit(None).cast("double") for c in ("range_min", "range_max", "step")})
    limits = "station_id int, variable_id int, interval int, month int, range_min double, range_max double"
    range_thr = spark.createDataFrame([], limits)
    step_thr = spark.createDataFrame([], "station_id int, variable_id int, interval int, step_min double, step_max double")
    layout = spark.createDataFrame([("V", 1, 3600)], "lookup_key string, variable_id int, seconds int")
    values = [10, 12, 30, 31, 70, 20, 21, 22, 5, 6]
    files = []
    for k in range(5):
        stamps = [dt.datetime(2024, 1, 1, 20) + dt.timedelta(hours=2 * k + j) for j in (0, 1)]
        rows = [f'"{t:%Y-%m-%d %H:%M:%S}",{j},{values[2 * k + j]}' for j, t in enumerate(stamps)]
        files.append("\n".join(['"TOA5","ST_x","C","1","p"', '"TIMESTAMP","RECORD","V"', '"TS","RN","n"', '"","","Smp"', *rows]))

    def flags(name, order):
        store = Store(spark, str(tmp_path / name / "store"), schema.OBS)
        folder = tmp_path / name / "in"
        folder.mkdir(parents=True)
        for some in order:
            for k in some:
                (folder / f"ST_{k}.dat").write_text(files[k])
            jobs.stream_file_ingest(
                jobs.line_stream(spark, str(folder)), store, layout, station, variable, range_thr, step_thr,
                str(tmp_path / name / "cp"), NOW,
            ).awaitTermination()
        return [r.quality_flag for r in store.table("obs").orderBy("datetime").collect()]

    whole = flags("whole", [[0, 1, 2, 3, 4]])
    assert whole == [4, 4, 3, 4, 3, 3, 4, 4, 3, 4]
    assert flags("late", [[1, 4], [0, 2, 3]]) == whole


def test_frame_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(frame() + frame(kind=0x39) + frame(lat=16.0))
    df = decode_lightning_frames(jobs.frame_stream(spark, str(tmp_path / "in")))
    jobs.append_to(df, str(tmp_path / "out"), str(tmp_path / "cp"), NOW).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.latitude for r in rows) == [16.0, 17.5]
    assert rows[0].datetime == dt.datetime(2024, 1, 15, 12, 0, 0, 500000)
