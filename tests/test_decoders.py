"""Decoders on literal files and messages."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from pluvio.functions.columns import number_or_null, parse_iso_z, positive_degrees, round_half_up, trunc_to
from pluvio.sources import lightning, loggers, manifest, satellite, sheets
from pluvio.sources.lines import csv_fields, read_lines

T = dt.datetime


@pytest.fixture(scope="module")
def station(spark):
    return spark.createDataFrame(
        [(7, "9922101", -360), (8, "9958303", 60)], "id int, code string, utc_offset_minutes int"
    )


@pytest.fixture(scope="module")
def formats(spark):
    return spark.createDataFrame(
        [("BattV_Min", 200, 3600), ("AirT_C_MAX_24hr", 16, 86400), ("Rain, total", 0, 600)],
        "lookup_key string, variable_id int, seconds int",
    )


def test_logger_file(spark, station, formats, tmp_path):
    text = (
        '"TOA5","9922101_creek","CR300","3890","CR300.Std.06"\r\n'
        '"TIMESTAMP","RECORD","BattV_Min","Rain, total","Other"\r\n'
        '"TS","RN","Volts","mm",""\r\n'
        '"","","Min","Tot","Smp"\r\n'
        '"2019-04-03 00:10:00",0,12.5\0,"NAN",5\r\n'
        '"2019-04-03 00:20:00",1,,0.25,5\r\n'
        '"2019-04-03 00:30:00",2,broken,"1.5",5\r\n'
    )
    (tmp_path / "9922101_creek.dat").write_text(text, newline="")
    rows = loggers.ingest_logger_csv(read_lines(spark, str(tmp_path)), formats, station).orderBy("datetime").collect()
    assert [(r.station_id, r.variable_id, r.seconds, r.datetime, r.measured, r.quality_flag) for r in rows] == [
        (7, 200, 3600, T(2019, 4, 3, 6, 10), 12.5, 1),
        (7, 0, 600, T(2019, 4, 3, 6, 20), 0.25, 1),
        (7, 0, 600, T(2019, 4, 3, 6, 30), 1.5, 1),
    ]


@pytest.mark.parametrize(
    "text,want",
    [
        ("12/13/18 12:00:00 AM", T(2018, 12, 13, 0)),
        ("12/13/18 12:59:59 AM", T(2018, 12, 13, 0, 59, 59)),
        ("12/13/18 12:00:00 PM", T(2018, 12, 13, 12)),
    ],
)
def test_hobo_file(spark, station, formats, tmp_path, text, want):
    body = (
        '"Plot Title: 9958303_hill"\n"#","Date Time, GMT-06:00","AirT_C_MAX_24hr, °C","Rainfall, mm"\n'
        f"1,{text},21.5,3\n2,not a time,1,1\nshort\n"
    )
    (tmp_path / "a.csv").write_bytes(body.encode("ISO-8859-1"))
    rows = loggers.ingest_hobo_csv(read_lines(spark, str(tmp_path), "ISO-8859-1"), formats, station).collect()
    assert [(r.station_id, r.variable_id, r.datetime, r.measured) for r in rows] == [
        (8, 16, want - dt.timedelta(hours=1), 21.5)
    ]


def test_wide_file(spark, station, tmp_path):
    variable = spark.createDataFrame([(1, "TMP"), (2, "HUM")], "id int, symbol string")
    (tmp_path / "wide_9958303_2019-05.csv").write_text(
        "datetime;TMP;HUM;XXX\n2019-05-01 00:00:00;1.5;;1\n2019-05-01 00:10:00;2.5;50;1\n"
        "2019-05-01 00:20:00;;51;1\n2019-05-01 00:30:00+00:00;4;52;1\n"
    )
    rows = loggers.ingest_wide_csv(read_lines(spark, str(tmp_path)), variable, station)
    got = sorted((r.variable_id, r.datetime, r.measured, r.seconds) for r in rows.collect())
    assert got == [
        (1, T(2019, 4, 30, 23, 0), 1.5, 600),
        (1, T(2019, 4, 30, 23, 10), 2.5, 600),
        (1, T(2019, 5, 1, 0, 30), 4.0, 600),
        (2, T(2019, 4, 30, 23, 10), 50.0, 600),
        (2, T(2019, 4, 30, 23, 20), 51.0, 600),
        (2, T(2019, 5, 1, 0, 30), 52.0, 600),
    ]


def test_quoted_commas(spark):
    df = spark.createDataFrame([('a,"b,c",,"d"',), ("1,2",), ('"x","y"',)], "line string")
    assert [r[0] for r in df.select(csv_fields(F.col("line"))).collect()] == [
        ["a", '"b,c"', "", '"d"'],
        ["1", "2"],
        ['"x"', '"y"'],
    ]


def test_satellite_header(spark):
    df = spark.createDataFrame(
        [("5020734E20131172412G44+0NN117EXE00278", "p"), ("5020734E99999999999G44+0NN117EXE00278", "bad time")],
        "header string, payload string",
    )
    (row,) = satellite.decode_dcp_header(df).collect()
    assert (row.address, row.datetime, row.failure_code, row.signal_strength, row.channel, row.source, row.length) == (
        "5020734E",
        T(2020, 5, 10, 17, 24, 12),
        "G",
        "44",
        "117",
        "XE",
        "00278",
    )


def test_satellite_lines_of_the_day_before(spark):
    df = spark.createDataFrame(
        [(1, "AB", "xAB24001003000G \r\n2350 1.5 M 3 \r\n0010 2 \r\nnoise \r\n")],
        "station_id int, address string, response string",
    )
    intervals = spark.createDataFrame([(i, 60) for i in range(1, 11)], "position int, seconds int")
    got = sorted((r.datetime, r.variable_id, r.measured) for r in satellite.decode_dcp_space_text(df, intervals).collect())
    assert got == [
        (T(2023, 12, 31, 23, 50), 16, 3.0),
        (T(2023, 12, 31, 23, 50), 200, 1.5),
        (T(2024, 1, 1, 0, 10), 200, 2.0),
    ]


@pytest.mark.parametrize("chunk,value", [("@@A", 1), ("@@?", 63), ("A@@", 4096), ("???", -1), ("`@@", -131072)])
def test_pseudobinary_value(spark, chunk, value):
    df = spark.createDataFrame([(chunk,)], "c string")
    assert df.select(satellite.pseudobinary_value(F.col("c"))).first()[0] == value


def test_battery(spark):
    df = spark.createDataFrame([("J",)], "c string")
    assert df.select(satellite.battery_volts(F.col("c"))).first()[0] == pytest.approx(12.34)


def frame(kind=0x38, lat=17.5, lon=-88.25, current=-12000):
    return struct.pack(
        ">BBIIiiiHBBBIIIiiiiB",
        kind, 0, 1705320000, 500_000_000, int(lat * 1e7), int(lon * 1e7), current, 900, 7, 1, 2,
        1705319999, 0, 42, int(lat * 1e7), int(lon * 1e7), int(lat * 1e7), int(lon * 1e7), 0,
    )


def test_lightning(spark, tmp_path):
    frames = [frame(), frame(kind=0x39), frame(lat=20.0), frame()[:20]]
    df = spark.createDataFrame([(f,) for f in frames], "frame binary")
    assert lightning.decode_lightning_frames(df).count() == 2
    (row,) = lightning.decode_lightning_frames(df, area=(15.0, 19.0, -90.0, -87.0)).collect()
    assert (row.type, row.datetime, row.latitude, row.longitude, row.peak_current, row.duration) == (
        "CG",
        T(2024, 1, 15, 12, 0, 0, 500000),
        17.5,
        -88.25,
        -12000,
        42,
    )


def test_coded_groups(spark):
    df = spark.createDataFrame([(1, "1234", "7"), (2, "", None), (3, "81234", "98")], "k int, cld1 string, pastww string")
    got = {(r.k, r.variable_id): r.measured for r in sheets.split_coded_groups(df, ["k"], ["cld1", "pastww"]).collect()}
    assert got == {
        (1, 1009): 1.0, (1, 1010): 2.0, (1, 1011): 34.0, (1, 1003): 0.0, (1, 1004): 7.0,
        (2, 1009): -99.9, (2, 1010): -99.9, (2, 1011): -99.9, (2, 1003): -99.9, (2, 1004): -99.9,
        (3, 1009): 1.0, (3, 1010): 2.0, (3, 1011): 34.0, (3, 1003): 9.0, (3, 1004): 8.0,
    }


def test_manifest(spark, tmp_path):
    for name, text in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (tmp_path / name).write_text(text)
    files = manifest.manifest_from_files(spark, str(tmp_path))
    assert files.select("file_hash").distinct().count() == 2
    rows = [(1, 1), (2, 6), (3, 1), (4, 3), (5, 1), (6, 4), (7, 1)]
    hashes = ["x", "x", "y", "y", "z", "z", "w"]
    table = spark.createDataFrame([(i, s, h) for (i, s), h in zip(rows, hashes)], "id long, status_id int, file_hash string")
    got = {r.id: r.decision for r in manifest.file_manifest_dedup(table).collect()}
    # waiting copies: the last one is read; a copy already read stops the rest; a failed one does not
    assert got == {1: "skip", 2: "process", 3: "skip", 5: "process", 7: "process"}


def test_scalars(spark):
    df = spark.createDataFrame(
        [("2024-01-01T10:00:00Z", "", 1.005, 33.339), ("2024-01-01T10:00:00.250Z", "3.1", 2.5, 12.0), ("x", "a", -1.005, 0.0)],
        "t string, n string, x double, y double",
    )
    rows = df.select(
        parse_iso_z("t").alias("t"), number_or_null("n").alias("n"), round_half_up("x", 2).alias("x"), trunc_to("y", 2).alias("y")
    ).collect()
    assert [r.t for r in rows] == [T(2024, 1, 1, 10), T(2024, 1, 1, 10, 0, 0, 250000), None]
    assert [r.n for r in rows] == [None, 3.1, None]
    assert [r.x for r in rows] == [1.01, 2.5, -1.01]
    assert [r.y for r in rows] == [33.33, 12.0, 0.0]
    assert df.limit(1).select(positive_degrees(F.lit(-1.5707963267948966))).first()[0] == pytest.approx(270.0)
