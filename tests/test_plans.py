"""Composed plans."""

import time
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from checks.decoders import logger_format, logger_lines
from checks.places import curves, points
from checks.quality import refreshed
from pluvio import schema
from pluvio.operators import qc
from pluvio.plans import ingest, refresh
from pluvio.schema import KEY
from pluvio.session import stored
from pluvio.streaming import jobs
from pluvio.streaming.store import Arrivals, Store


def test_files_to_readings(spark, tables):
    args = (tables.station(), tables.variable(), tables.range_thr(), tables.step_thr())
    rows = ingest.files_to_readings(logger_lines(tables), "TOA5", logger_format(tables), *args)
    assert rows.filter("quality_flag IS NULL OR qc_range_quality_flag IS NULL").count() == 0
    with pytest.raises(ValueError):
        ingest.files_to_readings(rows, "XLS", rows, *args)


def test_roll_ups_agree(spark, tables):
    tables_by_name = ingest.all_summaries(tables.obs(), tables.station())
    counts = {n: df.agg(F.sum("num_records")).first()[0] for n, df in tables_by_name.items()}
    assert len(set(counts.values())) == 1


def test_store_modes(spark, tables):
    obs = tables.obs()
    target = obs.filter("day(datetime) < 15")
    batch = obs.filter("day(datetime) >= 10").withColumn("measured", F.lit(1.0))
    kept = ingest.store_readings(target, batch, override=False)
    replaced = ingest.store_readings(target, batch, override=True)
    assert kept.count() == replaced.count() == obs.count()
    assert kept.filter("day(datetime) BETWEEN 10 AND 14 AND measured = 1.0").count() < replaced.filter(
        "day(datetime) BETWEEN 10 AND 14 AND measured = 1.0"
    ).count()


def test_refresh_settles_in_one_pass(spark, tables):
    """After the changed flags are stored, a second refresh finds nothing, and the flags are those of the whole history."""
    obs, late, limits = refreshed(tables)
    changed = qc.qc_persist_refresh(obs, late, limits)
    assert changed.count() > late.count() > 0
    flagged = stored(refresh.with_flags(obs, changed), "flagged")
    assert qc.qc_persist_refresh(flagged, late, limits).isEmpty()
    whole = qc.qc_persist_suspicious(qc.qc_persist_test(flagged.drop(*qc.PERSIST_RESULT), limits))
    both = flagged.select(*KEY, "qc_persist_quality_flag").exceptAll(whole.select(*KEY, "qc_persist_quality_flag"))
    assert both.isEmpty()


def test_files_by_decoder_in_batches(spark, tables, tmp_path):
    """A bad file is reported and stops no other, and a copy in a later batch is skipped."""
    station = spark.createDataFrame([(1, "ST1", 0, None, True)], "id int, code string, utc_offset_minutes int, reference_station_id int, is_automatic boolean")
    variable = tables.variable()
    layout = spark.createDataFrame([("V", 1, 3600)], "lookup_key string, variable_id int, seconds int")
    dims = ingest.Dimensions(station, variable, layout, layout, curves(tables), points(tables))
    head = '"TOA5","ST1"\n"TIMESTAMP","RECORD","V"\n"TS","RN","n"\n"","","Smp"\n'
    texts = {
        "ST1_good.dat": head + '"2024-01-01 01:00:00",1,5',
        "ST1_bad.dat": head + '"2024-01-01 02:00:00",1,6\nnoise',
        "ST1_bare.dat": '"2024-01-01 03:00:00",1,7',
        "XX_far.dat": head + '"2024-01-01 04:00:00",1,8',
        "ST1_odd.xls": "x",
        "ST1_copy.dat": head + '"2024-01-01 01:00:00",1,5',
        "wide_ST1_a.csv": "datetime;CLK\n2024-01-02 01:00:00;3\n2024-01-02 02:00:00;4",
    }
    names = list(texts)
    folder = tmp_path / "in"
    folder.mkdir()
    kinds = {"ST1_odd.xls": "SPREADSHEET", "wide_ST1_a.csv": "SURFACE"}
    rows = [(k, f"file:{folder}/{n}", kinds.get(n, "TOA5"), 1, str(hash(texts[n])), 1) for k, n in enumerate(names)]
    manifest = spark.createDataFrame(rows, "id long, filepath string, decoder string, station_id int, file_hash string, status_id int")
    store = Store(spark, str(tmp_path / "store"), schema.OBS, buckets=1)
    states = Arrivals(spark, str(tmp_path / "states"), StructType.fromDDL(jobs.STATES), "DATE'1970-01-01'")
    limits = qc.station_limits(station, range=tables.range_thr(), step=tables.step_thr())
    for some in (names[:5], names[5:]):
        for n in some:
            (folder / n).write_text(texts[n])
        jobs.stream_ingest_by_decoder(
            jobs.line_stream(spark, str(folder)), lambda: manifest, states, store, dims, limits, str(tmp_path / "cp"), {"availableNow": True}
        ).awaitTermination()
    found = {r.id: r for r in jobs.with_states(manifest, states).collect()}
    assert [found[k].status_id for k in range(7)] == [3, 4, 4, 4, 4, 5, 3]
    assert found[1].observation == 'Error Processing file with "TOA5" decoder. not a line of data: noise'
    assert "no header" in found[2].observation and "unknown station XX" in found[3].observation and "unknown decoder" in found[4].observation
    assert sorted(r.measured for r in store.table("obs").collect()) == [3.0, 4.0, 5.0]


def _sheet_files(spark, tables):
    """Sheets with their own order of columns, a spoilt logger file, and a manifest of them."""
    station = spark.createDataFrame([(1, "ST1", 0, None, True)], "id int, code string, utc_offset_minutes int, reference_station_id int, is_automatic boolean")
    layout = spark.createDataFrame([("V", 1, 3600)], "lookup_key string, variable_id int, seconds int")
    dims = ingest.Dimensions(station, tables.variable(), layout, layout, curves(tables), points(tables))
    texts = {
        "a": ("MANUAL DAILY", "day,rainfall,month\n3,1.5,2024-02\n30,2.5,2024-02\ntotal,,"),
        "b": ("MANUAL DAILY", "day,\"month\",other,rainfall,temp_max\n4,2024-03,x,7,8"),
        "c": ("TOA5", "\"TOA5\",\"ST1\"\n\"TIMESTAMP\",\"RECORD\",\"V\"\n2024-01-01 01:00:00,1,5\nb-a:d d\na worse:- one"),
        "ST1_d": ("TOA5", "\"TOA5\",\"ST1\"\n\"TIMESTAMP\",\"RECORD\",\"V\"\n2024-01-01 01:00:00,1,5"),
        "e": ("MANUAL DAILY", "month,rainfall\n2024-02,3"),
    }
    lines = spark.createDataFrame([(p, x) for p, (_, text) in texts.items() for x in text.split("\n")], "path string, line string")
    rows = [(k, p, kind, 1, p, 1) for k, (p, (kind, _)) in enumerate(texts.items())]
    manifest = spark.createDataFrame(rows, "id long, filepath string, decoder string, station_id int, file_hash string, status_id int")
    return manifest, lines, dims


def test_files_are_judged_before_lines_move(spark, tables, monkeypatch):
    """States need no routed lines: these are written once readings are asked for."""
    made = []
    monkeypatch.setattr(ingest, "shared_dir", lambda s, purpose, real=ingest.shared_dir: made.append(purpose) or real(s, purpose))
    found = ingest.ingest_by_decoder(*_sheet_files(spark, tables))
    states = {r.filepath: (r.status_id, r.observation) for r in found.states.collect()}
    assert [states[p][0] for p in ("a", "b", "c", "ST1_d", "e")] == [3, 3, 4, 3, 4]
    assert "unknown station c" in states["c"][1] and "no header" in states["e"][1] and not made
    rows = {(r.variable_id, str(r.datetime)): r.measured for r in found.readings.filter("measured <> -99.9").collect()}
    assert rows == {(0, "2024-02-03 00:00:00"): 1.5, (0, "2024-03-04 00:00:00"): 7.0, (16, "2024-03-04 00:00:00"): 8.0, (1, "2024-01-01 01:00:00"): 5.0}
    assert made == ["routed"]


def test_repeated_station_repeats_no_line(spark, tables):
    """A station that comes twice gives each of its readings twice, as a join does, whatever it does to the states."""
    manifest, lines, dims = _sheet_files(spark, tables)
    twice = replace(dims, station=dims.station.unionByName(dims.station))
    found = ingest.ingest_by_decoder(manifest, lines, twice)
    assert found.states.filter("filepath = 'ST1_d'").count() == 2
    assert found.readings.filter("variable_id = 1").count() == 2


def test_first_spoilt_line(spark, tables):
    """The first by text of several, though marks of a time stand in them."""
    manifest, lines, dims = _sheet_files(spark, tables)
    lines = lines.withColumn("path", F.replace("path", F.lit("c"), F.lit("ST1_c")))
    states = ingest.ingest_by_decoder(manifest.withColumn("filepath", F.replace("filepath", F.lit("c"), F.lit("ST1_c"))), lines, dims).states
    said = states.filter("filepath = 'ST1_c'").first().observation
    assert said == 'Error Processing file with "TOA5" decoder. not a line of data: a worse:- one'


def test_sheet_lines_meet_no_look_up(spark):
    """Columns of a sheet come from the places that stand beside each line, without a join or shuffle of the lines."""
    rows = spark.range(0).selectExpr("'p' AS path", "'1,2' AS line", "1 AS station_id", "array(1, 0, 2, 0) AS slots")
    plan = ingest._monthly(rows, ingest.RIVER_SHEET)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_stored_leaves_no_shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffled = lambda: {f.name for d in folders for f in Path(d).rglob("shuffle_*.data")}
    before = shuffled()
    sums = stored(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and sums.count() == 7
