"""The given star-schema tables read as an observation model.

events -> readings, supplier/nation/region -> stations, lineitem -> multi-year daily climate,
orders -> maintenance visits. Every table scales with its source; nothing is filtered away. Readings
are kept to 1/8 of a unit, the resolution of the sensors, so their sums are exact whatever the
partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio import schema
from pluvio.session import configure


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.dir = sf_dir.rstrip("/")
        self._plans: dict = {}

    def _once(self, key, build) -> DataFrame:
        """The plan of a table, built once per instance."""
        if key not in self._plans:
            self._plans[key] = build()
        return self._plans[key]

    def raw(self, name: str) -> DataFrame:
        reader = self.spark.read.schema(schema.SOURCES[name])
        return self._once(name, lambda: reader.parquet(f"{self.dir}/{name}.parquet"))

    def _literal(self, rows, ddl: str) -> DataFrame:
        """Fixed rows as a local relation, whose known size lets Catalyst broadcast it by itself."""
        return self._once((ddl, str(rows)), lambda: self._values(rows, ddl))

    def _values(self, rows, ddl: str) -> DataFrame:
        types = [field.strip().split() for field in ddl.split(",")]
        body = ", ".join("(" + ", ".join(_sql_literal(v) for v in row) + ")" for row in rows)
        raw = self.spark.sql(f"SELECT * FROM VALUES {body} AS v({', '.join(n for n, _ in types)})")
        return raw.select(*[F.col(name).cast(kind).alias(name) for name, kind in types])

    # facts -----------------------------------------------------------------------------------

    def event_readings(self) -> DataFrame:
        return event_readings(self.raw("events"))

    def obs(self) -> DataFrame:
        """One row per (station, variable, time); the highest event wins.

        One aggregate per source column instead of one struct of all of them: unused columns are
        pruned and the fixed-width ones stay in a hash aggregate.
        """
        newest = (
            _event_keys(self.raw("events"))
            .groupBy(*schema.KEY)
            .agg(
                F.max_by("value", "event_id").alias("value"),
                F.max_by("props", "event_id").alias("props"),
                F.max("event_id").alias("event_id"),
            )
        )
        return _reading_columns(newest).drop("event_id")

    def obs_regular(self) -> DataFrame:
        """Hourly series with a one-hour hole after every 20 readings."""
        k = F.expr("event_id % 240")
        series = F.expr("event_id div 240")
        return _reading_columns(
            self.raw("events")
            .withColumn("station_id", F.expr("event_id div 240 div 5").cast("int"))
            .withColumn("variable_id", (series % 5 + 1).cast("int"))
            .withColumn(
                "datetime",
                F.timestamp_seconds(F.lit(1706140800) + (k + F.expr("event_id % 240 div 20")) * F.lit(3600)),
            )
            .withColumn("seconds", F.lit(3600))
        ).drop("event_id")

    def hf(self) -> DataFrame:
        """Sea level at 1 Hz, half an hour per station."""
        return self.raw("events").select(
            F.expr("event_id div 1800").cast("int").alias("station_id"),
            F.lit(9).alias("variable_id"),
            F.timestamp_seconds(F.lit(1705320001) + F.expr("event_id % 1800")).alias("datetime"),
            (F.floor(F.col("value") * 8) / 8).alias("measured"),
        )

    def climate_daily(self) -> DataFrame:
        return (
            self.raw("lineitem")
            .select(
                F.col("l_suppkey").cast("int").alias("station_id"),
                F.when(F.col("l_returnflag") == "A", 6)
                .when(F.col("l_returnflag") == "N", 7)
                .otherwise(8)
                .alias("variable_id"),
                F.to_date("l_shipdate").alias("day"),
                "l_quantity",
            )
            .groupBy("station_id", "variable_id", "day")
            .agg(
                F.min("l_quantity").alias("min_value"),
                F.max("l_quantity").alias("max_value"),
                F.avg("l_quantity").alias("avg_value"),
                F.sum("l_quantity").alias("sum_value"),
                F.count("l_quantity").alias("num_records"),
            )
        )

    # dimensions ------------------------------------------------------------------------------

    def station_places(self) -> DataFrame:
        """Stations with region and watershed."""
        return (
            self._station("s_nationkey")
            .join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumnsRenamed({"n_name": "region", "r_name": "watershed"})
            .drop("s_nationkey", "n_nationkey", "n_regionkey", "r_regionkey")
        )

    def station(self) -> DataFrame:
        """Stations as operators need them; read from one table, so that its size is known to Spark."""
        return self._once("station", self._station)

    def _station(self, *more: str) -> DataFrame:
        sid = F.col("s_suppkey")
        return (
            self.raw("supplier")
            .select(
                *more,
                sid.cast("int").alias("id"),
                F.col("s_name").alias("name"),
                F.concat(F.lit("ST"), F.lpad(sid.cast("string"), 6, "0")).alias("code"),
                F.concat(F.lit("alias "), (sid % 50).cast("string")).alias("alias_name"),
                F.concat(F.lit("site "), sid.cast("string")).alias("alternative_names"),
                ((F.lit(150) + sid * 37 % 40).cast("double") / 10).alias("latitude"),
                ((F.lit(-900) + sid * 53 % 30).cast("double") / 10).alias("longitude"),
                F.when(sid % 3 == 0, sid + 1).cast("int").alias("reference_station_id"),
                ((sid % 5 - 2) * 180).cast("int").alias("utc_offset_minutes"),
                (sid % 7 != 6).alias("is_active"),
                (sid % 2 == 0).alias("is_automatic"),
                (sid % 4).cast("int").alias("profile_id"),
                F.lit("2023-06-01").cast("date").alias("begin_date"),
                F.when(sid % 6 == 5, F.lit("2024-01-10").cast("date")).alias("end_date"),
            )
        )

    def variable(self) -> DataFrame:
        return self._literal(
            VARIABLES,
            "id int, symbol string, name string, variable_type string, sampling_operation_id int, unit_id int,"
            " measurement_variable_id int, color string, range_min double, range_max double,"
            " range_min_hourly double, range_max_hourly double, step double, step_hourly double,"
            " persistence double, persistence_hourly double, persistence_window int, persistence_window_hourly int",
        )

    def unit(self) -> DataFrame:
        return self._literal(UNITS, "id int, symbol string, name string")

    def measurement_variable(self) -> DataFrame:
        return self._literal(MEASUREMENT_VARIABLES, "id int, name string")

    def flag(self) -> DataFrame:
        return self._literal(schema.FLAGS, "id int, symbol string, name string, color string")

    def station_variable(self) -> DataFrame:
        return self.station().select(
            F.col("id").alias("station_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("variable_id")
        )

    # thresholds ------------------------------------------------------------------------------

    def _threshold_owner(self) -> DataFrame:
        """Stations with id mod 4 = 0 hold limits for 3600 s, those with 1 for any interval."""
        sid = F.col("id")
        return (
            self.station()
            .filter(sid % 4 <= 1)
            .select(
                sid.alias("station_id"),
                F.when(sid % 4 == 0, F.lit(3600)).alias("interval"),
                F.explode(F.sequence(F.lit(1), F.when(sid % 4 == 0, F.lit(2)).otherwise(F.lit(4)))).alias(
                    "variable_id"
                ),
            )
        )

    def range_thr(self) -> DataFrame:
        return self._threshold_owner().select(
            "station_id",
            "variable_id",
            "interval",
            F.explode(F.array(F.lit(1), F.lit(2))).alias("month"),
            (F.col("station_id") % 5 + F.col("variable_id")).cast("double").alias("range_min"),
            (F.lit(60) + F.col("station_id") % 50).cast("double").alias("range_max"),
        )

    def step_thr(self) -> DataFrame:
        size = (F.lit(20) + F.col("station_id") % 10).cast("double")
        return self._threshold_owner().select(
            "station_id", "variable_id", "interval", (-size).alias("step_min"), size.alias("step_max")
        )

    def persist_thr(self) -> DataFrame:
        """One row for each window the two kinds of station use."""
        v = self.variable().select(
            F.col("id").alias("variable_id"),
            F.explode(
                F.array(
                    F.coalesce("persistence_window", F.lit(96)) * 3600,
                    F.coalesce("persistence_window_hourly", F.lit(1)) * 3600,
                )
            ).alias("window"),
        )
        return (
            self._threshold_owner()
            .join(v, "variable_id")
            .select(
                "station_id",
                "variable_id",
                "interval",
                "window",
                (F.lit(3) + F.col("station_id") % 5).cast("double").alias("minimum_variance"),
            )
        )


def _sql_literal(value) -> str:
    if value is None:
        return "NULL"
    return f"'{value}'" if isinstance(value, str) else repr(value)


def _reading_columns(df: DataFrame) -> DataFrame:
    value = F.floor(F.col("value") * 8) / 8
    e = F.col("event_id")
    coded = F.col("event_type") == "view" if "event_type" in df.columns else F.col("variable_id") == 5
    keep = [c for c in ("seconds", "event_id") if c in df.columns]
    return df.select(
        *keep,
        "station_id",
        "variable_id",
        "datetime",
        F.when(e % 97 == 0, F.lit(-99.9)).otherwise(value).alias("measured"),
        F.when(e % 53 == 0, value + 1.0).alias("consisted"),
        F.when(e % 10 <= 1, 3).when(e % 10 == 2, 2).when(e % 10 <= 4, 1).otherwise(4).alias("quality_flag"),
        F.when(e % 31 == 0, 4).when(e % 37 == 0, 3).alias("manual_flag"),
        (e % 41 == 0).alias("is_daily"),
        F.when(e % 29 == 0, F.concat(F.lit("note "), e.cast("string"))).alias("remarks"),
        F.when(e % 23 == 0, F.concat(F.lit("obs "), (e % 7).cast("string"))).alias("observer"),
        F.when(coded, F.col("props")).alias("code"),
        F.lit(1).alias("ml_flag"),
    )


def event_readings(events: DataFrame) -> DataFrame:
    """Readings before the unique key is enforced; also used on the stream of events."""
    return _reading_columns(_event_keys(events))


def _event_keys(events: DataFrame) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    kind = F.col("event_type")
    return events.withColumns(
        {
            "station_id": F.expr("user_id div 5").cast("int"),
            "variable_id": F.when(kind == "click", 1)
            .when(kind == "error", 2)
            .when(kind == "purchase", 3)
            .when(kind == "signup", 4)
            .otherwise(5),
            "datetime": F.when(F.col("event_id") % 4 == 0, F.date_trunc("hour", at)).otherwise(
                F.date_trunc("minute", at)
            ),
        }
    )


def latest_per_key(readings: DataFrame) -> DataFrame:
    rest = [c for c in readings.columns if c not in (*schema.KEY, "event_id")]
    return (
        readings.groupBy(*schema.KEY)
        .agg(F.max_by(F.struct(*rest), "event_id").alias("_r"))
        .select(*schema.KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


# Variables 1-5 belong to readings, 6-8 to the daily climate, 9 to the wave gauge.
VARIABLES = [
    (1, "CLK", "Click rate", "Numeric", 1, 1, 1, "#111111", 0.0, 200.0, 0.0, 150.0, 60.0, 40.0, 5.0, 2.0, None, None),
    (2, "ERR", "Error level", "Numeric", 2, 2, 1, "#222222", 0.0, 100.0, 0.0, 80.0, None, 30.0, 4.0, 1.0, 48, 6),
    (3, "PUR", "Purchase depth", "Numeric", 6, 3, 2, "#333333", None, None, 0.0, 250.0, 80.0, None, None, 3.0, 96, 12),
    (4, "SGN", "Signup height", "Numeric", 3, None, 3, "#444444", 0.0, 300.0, None, None, 50.0, 50.0, 2.0, None, 24, 3),
    (5, "VIEW", "View code", "Code", 4, 1, 3, "#555555", None, None, None, None, None, None, None, None, None, None),
    (6, "ACC", "Rain total", "Numeric", 6, 3, 2, "#666666", None, None, None, None, None, None, None, None, None, None),
    (7, "TMAX", "Highest temperature", "Numeric", 4, 2, 4, "#777777", None, None, None, None, None, None, None, None, None, None),
    (8, "TMIN", "Lowest temperature", "Numeric", 3, 2, 4, "#888888", None, None, None, None, None, None, None, None, None, None),
    (9, "SLV", "Sea level", "Numeric", 1, 3, 3, "#999999", None, None, None, None, None, None, None, None, None, None),
]
UNITS = [(1, "n", "count"), (2, "C", "degree Celsius"), (3, "mm", "millimetre")]
MEASUREMENT_VARIABLES = [(1, "Web Load"), (2, "Water Amount"), (3, "Gauge Height"), (4, "Air Temperature")]
