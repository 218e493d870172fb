"""Rules that the generated tables reach rarely or not at all."""

import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from pluvio.functions.columns import round_half_even
from pluvio.operators import climatology, equipment, gapfill, qc, rating, retrieve, signal, spatial, summary, write
from pluvio.session import configure
from pluvio.sources import manifest, sheets

T = dt.datetime
OBS = "station_id int, variable_id int, datetime timestamp, measured double, consisted double, quality_flag int, manual_flag int, is_daily boolean"


def obs(spark, *rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], OBS)


def test_hour_and_day_are_right_closed_at_midnight(spark):
    station = spark.createDataFrame([(1, -360)], "id int, utc_offset_minutes int")
    o = obs(
        spark,
        (T(2024, 1, 2, 0, 0), 1.0, None, 4, None, False),
        (T(2024, 1, 2, 6, 0), 2.0, None, 4, None, False),
        (T(2024, 1, 2, 6, 0, 1), 4.0, None, 4, None, False),
        (T(2024, 1, 2, 6, 0), 8.0, None, 4, None, True),
    )
    hours = {(r.datetime, r.is_daily): r.sum_value for r in summary.hourly_summary(o).collect()}
    assert hours == {(T(2024, 1, 1, 23), False): 1.0, (T(2024, 1, 2, 6), False): 6.0, (T(2024, 1, 2, 6), True): 8.0}
    days = {(r.day, r.is_daily): r.sum_value for r in summary.daily_summary(o, station).collect()}
    assert days == {(dt.date(2024, 1, 1), False): 3.0, (dt.date(2024, 1, 2), False): 4.0, (dt.date(2024, 1, 2), True): 8.0}


def test_manual_flag_decides(spark):
    o = obs(
        spark,
        (T(2024, 1, 1, 1), 1.0, None, 3, 4, False),
        (T(2024, 1, 1, 2), 2.0, None, 4, 3, False),
        (T(2024, 1, 1, 3), -99.9, 3.0, 4, None, False),
        (T(2024, 1, 1, 4), -99.9, None, 4, None, False),
    )
    assert sorted(r.sum_value for r in summary.hourly_summary(o).collect()) == [1.0, 3.0]


def test_completeness_of_days_without_data(spark):
    station = spark.createDataFrame([(1, 0)], "id int, utc_offset_minutes int")
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "station_id int, variable_id int")
    o = obs(spark, *[(T(2024, 1, 1, h), 1.0, None, 4, None, False) for h in range(1, 24)])
    rows = summary.completeness_daily(o, pairs, station, dt.date(2024, 1, 1), dt.date(2024, 1, 2)).collect()
    got = {(r.variable_id, r.day.day): (r.minimum_interval, r.record_count, r.ideal_record_count) for r in rows}
    assert got == {(1, 1): (3600, 23, 24), (1, 2): (None, 0, 0), (2, 1): (None, 0, 0), (2, 2): (None, 0, 0)}


def test_december_form_and_tie_of_extremes(spark):
    pairs = spark.createDataFrame([(1, 1)], "station_id int, variable_id int")
    o = obs(spark, (T(2023, 12, 31, 18), 5.0, None, 4, None, False))
    grid = retrieve.form_grid_12h(o, pairs, dt.date(2023, 12, 15)).collect()
    assert len(grid) == 31 and [r.value_06pm for r in grid if r.day.day == 31] == [5.0]
    daily = spark.createDataFrame(
        [(1, 1, dt.date(y, 1, 5), v, v, v, v, 1) for y, v in ((2000, 7.0), (2001, 9.0), (2002, 9.0))],
        "station_id int, variable_id int, day date, min_value double, max_value double, avg_value double, sum_value double, num_records long",
    )
    rows = climatology.extremes_maximum(daily, month=1).collect()
    assert sorted((r.year, r.agg_value, r.years, r.value) for r in rows) == [(2001, 9.0, 3, 8.33), (2002, 9.0, 3, 8.33)]
    (line,) = climatology.extremes_month_summary(climatology.extremes_maximum(daily, month=1), "maximum").collect()
    assert (line.year, line.agg_value) == (2001, 9.0)


@pytest.mark.parametrize(
    "persist,range_,step,want",
    [(3, 4, 4, 3), (1, 4, 2, 4), (2, 1, 1, 2), (1, 1, 1, 1), (2, 4, 1, 4)],
)
def test_final_flag(spark, persist, range_, step, want):
    df = spark.createDataFrame(
        [(persist, range_, step)], "qc_persist_quality_flag int, qc_range_quality_flag int, qc_step_quality_flag int"
    )
    assert df.select(qc.final_flag()).first()[0] == want


def test_thresholds_of_unknown_station_are_not_found(spark, tables):
    keys = spark.createDataFrame([(999999, 1, 3600, 1)], "station_id int, variable_id int, interval int, month int")
    row = qc.resolve_range_threshold(keys, tables.range_thr(), tables.station(), tables.variable()).first()
    assert (row.range_min, row.range_max, row.range_description) == (None, None, None)


def test_step_test_with_last_stored_row(spark, tables):
    batch = spark.createDataFrame(
        [(0, 1, T(2024, 1, 1, 1), 500.0, 3600)], "station_id int, variable_id int, datetime timestamp, measured double, seconds int"
    )
    stored = batch.withColumn("datetime", F.lit(T(2024, 1, 1, 0))).withColumn("measured", F.lit(0.0))
    args = (tables.step_thr(), tables.station(), tables.variable())
    assert qc.qc_step_test(batch, *args).first().qc_step_description == qc.NO_NEIGHBOUR
    assert qc.qc_step_test(batch, *args, last_stored=stored).first().qc_step_quality_flag == 3


def test_upsert_clears_corrections_and_keeps_creation(spark):
    schema = OBS + ", created_at timestamp"
    old, new = T(2020, 1, 1), T(2024, 1, 1)
    target = spark.createDataFrame([(1, 1, T(2024, 1, 1), 1.0, 5.0, 3, 4, False, old), (1, 1, T(2024, 1, 2), 2.0, 6.0, 3, 4, False, old)], schema)
    batch = spark.createDataFrame([(1, 1, T(2024, 1, 1), 9.0, 7.0, 4, 4, False, new), (1, 1, T(2024, 1, 3), 3.0, 7.0, 4, 4, False, new)], schema)
    rows = {r.datetime.day: (r.measured, r.consisted, r.manual_flag, r.created_at) for r in write.upsert_override(target, batch).collect()}
    assert rows == {1: (9.0, None, None, old), 2: (2.0, 6.0, 4, old), 3: (3.0, None, None, new)}


def test_rating_curve_edges(spark):
    curves = spark.createDataFrame([(1, 1, T(2020, 1, 1)), (2, 1, T(2021, 1, 1))], "id int, station_id int, start_date timestamp")
    points = spark.createDataFrame(
        [(c, h, h * 10 * c) for c in (1, 2) for h in (1.0, 2.0, 4.0)], "rating_curve_id int, h double, q double"
    )
    cases = [
        (T(2020, 1, 1), 1.0, -99.9),  # the curve starts strictly before the reading
        (T(2020, 6, 1), 1.0, 10.0),
        (T(2020, 6, 1), 3.0, 30.0),
        (T(2020, 6, 1), 4.0, 40.0),
        (T(2020, 6, 1), 4.5, -99.9),
        (T(2020, 6, 1), 0.5, -99.9),
        (T(2021, 1, 1), 2.0, 20.0),
        (T(2021, 1, 2), 2.0, 40.0),
        (T(2021, 1, 2), -99.9, -99.9),
    ]
    levels = spark.createDataFrame([(1, t, v) for t, v, _ in cases], "station_id int, datetime timestamp, measured double")
    got = {(r.datetime, r.measured): r.flow for r in rating.rating_curve_flow(levels, curves, points).collect()}
    assert got == {(t, v): q for t, v, q in cases}


def generated_curves(spark):
    """Curves and points whose number Spark can't tell from the bytes they are made of."""
    curves = spark.range(40).select(
        F.col("id").cast("int").alias("station_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    ).select(
        (F.col("station_id") * 10 + F.col("i")).alias("id"), "station_id", F.expr("cast(concat(2020 + i, '-01-01') AS timestamp)").alias("start_date")
    )
    points = curves.select(
        F.col("id").alias("rating_curve_id"), F.explode(F.array(*[F.lit(float(h)) for h in range(1, 9)])).alias("h")
    ).withColumn("q", F.col("h") * 10 + F.col("rating_curve_id"))
    return curves, points


def physical_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rating_curves_are_not_broadcast(spark):
    curves, points = generated_curves(spark)
    levels = spark.createDataFrame([(7, T(2022, 5, 1), 2.5), (3, T(2020, 5, 1), 8.0), (99, T(2020, 5, 1), 8.0)], "station_id int, datetime timestamp, measured double")
    flows = rating.rating_curve_flow(levels, curves, points)
    assert "Broadcast" not in physical_plan(flows)
    assert {(r.station_id, r.flow) for r in flows.collect()} == {(7, 97.0), (3, 110.0), (99, -99.9)}


def test_river_sheet_broadcasts_no_curves(spark):
    curves, points = generated_curves(spark)
    station = spark.createDataFrame([(7, 0)], "id int, utc_offset_minutes int")
    rows = spark.createDataFrame([(7, dt.date(2022, 5, 1), "2", "2.5", "dry")], "station_id int, month_start date, day string, level_6am string, level_6pm string")
    sheet = sheets.ingest_river_sheet(rows, station, curves, points)
    plan = physical_plan(sheet)
    # the stations may be broadcast, the curves and their steps not
    assert plan.count("SortMergeJoin") >= 2 and plan.count("BroadcastHashJoin") <= 1
    assert {(r.variable_id, r.datetime, r.measured) for r in sheet.collect()} == {
        (4015, T(2022, 5, 2, 6), 2.5),
        (4016, T(2022, 5, 2, 6), 97.0),
    }


def test_manifest_counts_are_not_broadcast(spark):
    files = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 2)], "id long, file_hash string, status_id int")
    decided = manifest.file_manifest_dedup(files)
    assert "Broadcast" not in physical_plan(decided)
    assert {(r.id, r.decision) for r in decided.collect()} == {(1, "skip"), (2, "process")}


def test_export_is_written_by_several_tasks(spark, tmp_path):
    wide = spark.range(40).select(F.col("id").alias("station_id"), F.lit("2024").alias("Year"), F.lit("01").alias("Month"), F.lit(1.0).alias("CLK"))
    gapfill.export_station_csv(wide, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("station_id=*/part-*.csv"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1


def test_contour_levels_and_grid_size(spark):
    df = spark.createDataFrame([("a", 1.2), ("a", 3.9), ("b", -0.5), ("b", 0.5)], "s string, value double")
    got = {r.s: r.levels for r in spatial.contour_levels(df, ["s"]).collect()}
    assert got == {"a": [0, 1, 2, 3], "b": [-1, 0]}
    assert spatial._steps(-90.0, -87.0, 0.01) == 300


def test_report_span(spark):
    with pytest.raises(ValueError):
        retrieve.check_span("raw", "2024-01-01 00:00:00", "2024-01-09 00:00:00")
    retrieve.check_span("monthly", "2000-01-01 00:00:00", "2024-01-09 00:00:00")


def test_ties_to_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (-0.125,), (1.236,), (None,)], "x double")
    got = [r.y for r in df.select(round_half_even("x", 2).alias("y")).collect()]
    assert got == [0.12, 0.38, -0.12, 1.24, None]


def test_fine_export_grid(spark):
    pairs = spark.createDataFrame([(1, 1)], "station_id int, variable_id int")
    grid = gapfill._fine_grid(pairs, "2024-01-01 00:00:00", "2024-01-03 12:00:00", 7 * 60)
    times = sorted(r.datetime for r in grid.collect())
    steps = int((2.5 * 86400 - 1) // 420) + 1
    assert times == [T(2024, 1, 1) + dt.timedelta(minutes=7 * i) for i in range(steps)]


def test_known_waves_are_found(spark):
    n = 1800
    df = (
        spark.range(1, n + 1)
        .select(
            F.lit(1).alias("station_id"),
            F.lit(9).alias("variable_id"),
            F.timestamp_seconds(F.lit(1705320000) + F.col("id")).alias("datetime"),
            (
                F.lit(10.0)
                + 2.0 * F.sin(2 * 3.141592653589793 * 0.1 * (F.col("id") - 1) + 0.5)
                + 0.5 * F.sin(2 * 3.141592653589793 * 0.25 * (F.col("id") - 1) + 1.0)
            ).alias("measured"),
        )
    )
    rows = signal.wave_components(signal.in_windows(df, 30)).orderBy("component").collect()
    assert [(round(r.frequency, 6), round(r.amplitude, 6)) for r in rows] == [(0.1, 2.0), (0.25, 0.5)]
    assert [round(r.phase, 3) for r in rows] == [28.648, 57.296]


def test_step_of_unknown_interval(spark):
    """A reading without an interval is not judged by its difference; one at its interval is."""
    rows = spark.createDataFrame(
        [(1, None, 3600, 50.0), (2, 3600, 3600, 50.0), (3, 3600, 3600, 1.0), (4, 3600, 7200, 1.0)],
        "id int, seconds int, diff_seconds long, diff_value double",
    ).selectExpr("*", "-2.0D AS step_min", "2.0D AS step_max", "'limits' AS step_description")
    got = {r.id: (r.flag, r.message) for r in rows.select("id", qc.step_flag().alias("flag"), qc.step_message().alias("message")).collect()}
    assert got == {
        1: (qc.NOT_CHECKED, qc.NO_NEIGHBOUR),
        2: (qc.BAD, "limits"),
        3: (qc.GOOD, "limits"),
        4: (qc.NOT_CHECKED, qc.NO_NEIGHBOUR),
    }


def _even_odd(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_polygon_cells_equal_the_even_odd_rule(spark):
    rng = random.Random(5)
    shapes = []
    for k in range(12):
        cx, cy, n = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randint(3, 40)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
        ring = [(cx + rng.uniform(0.2, 4) * math.cos(a), cy + rng.uniform(0.2, 4) * math.sin(a)) for a in turns]
        if k % 3 == 0:  # corners on cell borders, level and upright edges
            ring = [(round(x), round(y)) for x, y in ring]
        hole = [(cx - 0.1, cy - 0.1), (cx + 0.1, cy - 0.1), (cx + 0.1, cy + 0.1), (cx - 0.1, cy + 0.1)]
        shapes.append((f"p{k:02d}", [[*ring, ring[0]], [*hole, hole[0]]]))
    shapes += [("q", [[(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0)]]), ("none", None), ("empty", [])]
    where = [(rng.uniform(-8, 10), rng.uniform(-8, 10)) for _ in range(3000)]
    where += [(float(i), float(j)) for i in range(-4, 10) for j in range(-4, 10)] + [(None, 1.0)]
    points = spark.createDataFrame([(i, *xy) for i, xy in enumerate(where)], "id int, longitude double, latitude double")
    areas = spark.createDataFrame(
        [(n, r if r is None else [[tuple(map(float, p)) for p in ring] for ring in r]) for n, r in shapes],
        "name string, rings array<array<struct<x: double, y: double>>>",
    )
    areas = areas.union(areas)  # a repeated area is one
    expected = {}
    for i, (x, y) in enumerate(where):
        names = [] if x is None else [n for n, r in shapes if r and _even_odd(r, x, y)]
        expected[i] = min(names, default="NOT FOUND")
    for cell in (0.5, 1.0, 3.7):
        got = {r.id: r.area for r in spatial.point_in_polygon(points, areas, "area", cell).collect()}
        assert got == expected
    # a cell of the large square away from its border keeps one mark and no edge
    square = spatial.polygon_cells(areas.filter("name = 'q'"), 1.0).filter("_cx = 4 AND _cy = 4").collect()[0]
    assert [(c.edges, c.breaks) for c in square._candidates] == [([], [math.inf])]


def test_exact_median_of_large_skewed_and_odd_groups(spark):
    rng = random.Random(3)
    groups = {
        "wide": [rng.expovariate(1) ** 9 for _ in range(60_001)],
        "tied": [float(rng.randint(0, 3)) for _ in range(30_000)],
        "split": [0.0] * 15_000 + [1.0] * 15_000,
        "two": [1.0, 4.0],
        "one": [-0.5],
        "nan": [1.0, math.nan, math.nan],
        "nulls": [None, 3.0, None, 5.0, 9.0],
        "void": [None],
        None: [2.0, 8.0],
    }
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(7)
    got = {r.g: r.median for r in retrieve.exact_median(rows, ["g"], "v").collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        if g == "nan":
            assert math.isnan(got[g])
        else:
            known = [v for v in values if v is not None]
            assert got[g] == (statistics.median(known) if known else None)
    assert retrieve.exact_median(rows.limit(0), ["g"], "v").collect() == []


def test_equipment_history_counts_nulls_as_changes(spark):
    rows = [(1, T(2024, 1, d), v) for d, v in ((1, None), (2, "a"), (3, "a"), (4, None), (5, None), (6, "b"))]
    history = spark.createDataFrame(rows, "equipment_id int, datetime timestamp, state string")
    got = sorted((r.datetime.day, r.old_value, r.new_value) for r in equipment.equipment_change_history(history, ["state"]).collect())
    assert got == [(2, None, "a"), (4, "a", None), (6, None, "b")]


def test_tasks_read_a_bounded_part_of_large_files(spark):
    """So that the first half of an aggregate over nearly distinct keys holds what it reads; small files are packed as before."""
    settings = configure(spark)._jsparkSession.sessionState().conf()
    assert settings.filesMaxPartitionBytes() <= 16 << 20
    assert settings.filesMaxPartitionBytes() // settings.filesOpenCostInBytes() == 32
