"""Series helpers against brute force on one crowded series."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pluvio.functions.series import complete_rolling_sum, sliding_max, with_previous

START = dt.datetime(2024, 1, 1)


def make(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for key, share in ((1, 0.9), (2, 0.08), (3, 0.02)):
        seconds = sorted(rng.sample(range(0, 20 * 86400, 60), int(n * share)))
        rows += [(key, START + dt.timedelta(seconds=s), float(rng.randint(0, 50))) for s in seconds]
    return rows, spark.createDataFrame(rows, "station_id int, datetime timestamp, v double")


@pytest.mark.parametrize("seed", [1, 2])
def test_with_previous(spark, seed):
    rows, df = make(spark, seed)
    got = {(r.station_id, r.datetime): (r.prev_datetime, r.prev_v) for r in with_previous(df, ["station_id"], ["v"]).collect()}
    want = {}
    for key in (1, 2, 3):
        before = (None, None)
        for k, t, v in sorted(r for r in rows if r[0] == key):
            want[(k, t)] = before
            before = (t, v)
    assert got == want


@pytest.mark.parametrize("ahead", [False, True])
@pytest.mark.parametrize("hours", [1, 7, 96])
def test_sliding_max(spark, ahead, hours):
    rows, df = make(spark, 5)
    width = F.when(F.col("station_id") == 1, F.lit(hours * 3600)).otherwise(F.lit(1800))
    got = {
        (r.station_id, r.datetime): r.m
        for r in sliding_max(df, ["station_id"], width, {"m": F.col("v")}, ahead=ahead).collect()
    }
    want = {}
    for k, t, _ in rows:
        w = dt.timedelta(hours=hours) if k == 1 else dt.timedelta(minutes=30)
        low, high = (t, t + w) if ahead else (t - w, t)
        want[(k, t)] = max(v for k2, t2, v in rows if k2 == k and low <= t2 <= high)
    assert got == want


def test_sliding_max_includes_both_ends(spark):
    rows = [(1, START + dt.timedelta(hours=h), float(v)) for h, v in ((0, 9), (6, 1), (12, 2))]
    df = spark.createDataFrame(rows, "station_id int, datetime timestamp, v double")
    got = sliding_max(df, ["station_id"], F.lit(6 * 3600), {"m": F.col("v")}).orderBy("datetime").collect()
    assert [r.m for r in got] == [9.0, 9.0, 2.0]


@pytest.mark.parametrize("previous,span", [(0, 3600), (3, 4 * 3600), (5, 3 * 86400)])
def test_complete_rolling_sum(spark, previous, span):
    rows, df = make(spark, 7)
    got = {
        (r.station_id, r.datetime): r.acc
        for r in complete_rolling_sum(df, ["station_id"], "v", previous, span).collect()
    }
    want = {}
    for key in (1, 2, 3):
        series = sorted(r for r in rows if r[0] == key)
        for i in range(previous, len(series)):
            part = series[i - previous : i + 1]
            if part[-1][1] - part[0][1] < dt.timedelta(seconds=span):
                want[(key, part[-1][1])] = sum(v for *_, v in part)
    assert got == want


def test_one_pass_over_the_input(spark):
    """The two branches of with_previous share the shuffle of the input."""
    _, df = make(spark, 1)
    stepped = with_previous(df, ["station_id"], ["v"])
    stepped.collect()
    plan = stepped._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
