"""Tables of the streaming jobs: Parquet folders by day and bucket, replaced by versions.

A micro-batch replaces the (day, bucket) folders it touches. Their new content is written once, beside the old, under
the next version; then one small file of the table's log names the new versions, and with that readers
see all of them or none. The log also keeps the token of the batch, so a batch that is run again after a failure is not applied twice.
Of a folder's versions the last two stay, for readers that are still at work; older ones are removed at once.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvio.operators import summary, write
from pluvio.session import configure, exists, remove

HOURLY = "station_id int, variable_id int, datetime timestamp, is_daily boolean, min_value double, max_value double, avg_value double, sum_value double, num_records bigint"
DAILY = "station_id int, variable_id int, day date, is_daily boolean, min_value double, max_value double, avg_value double, sum_value double, num_records bigint"
STROKES = "window_start timestamp, type string, strokes bigint, strongest bigint"
FILES = "digest string, path string, first_day date"
LOG = "part date, bucket int, version bigint, present boolean, token string"

BUCKETS = 8
# Commits after which the log is written anew as a whole.
LOG_COMMITS = 64

Place = tuple[dt.date, int]


@dataclass(frozen=True)
class Table:
    """Columns, the expression of the day, and the column whose hash gives the bucket."""

    schema: T.StructType
    day: str
    spread: str


class Store:
    def __init__(self, spark: SparkSession, root: str, obs_schema: T.StructType, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = configure(spark), root, buckets
        # the interval is kept beside the reading, for the step test of later neighbours
        obs = T.StructType([*obs_schema.fields, T.StructField("seconds", T.IntegerType())])
        self.tables = {
            "obs": Table(obs, "to_date(datetime)", "station_id"),
            "hourly": Table(T.DataType.fromDDL(HOURLY), "to_date(datetime)", "station_id"),
            "daily": Table(T.DataType.fromDDL(DAILY), "day", "station_id"),
            "strokes": Table(T.DataType.fromDDL(STROKES), "to_date(window_start)", "type"),
            "files": Table(T.DataType.fromDDL(FILES), "first_day", "digest"),
        }
        self._ready: set[str] = set()

    # places -----------------------------------------------------------------------------------

    def placed(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows with their ``part`` (day) and ``bucket``."""
        table = self.tables[name]
        return rows.withColumns(
            {"part": F.expr(table.day), "bucket": F.pmod(F.xxhash64(table.spread), F.lit(self.buckets)).cast("int")}
        )

    def places(self, name: str, rows: DataFrame) -> list[Place]:
        """The folders that rows belong to: at most days times buckets."""
        return [(r.part, r.bucket) for r in self.placed(name, rows).select("part", "bucket").distinct().collect()]

    # versions ---------------------------------------------------------------------------------

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _folder(self, name: str, place: Place, version: int) -> str:
        return f"{self._path(name)}/part={place[0]}/bucket={place[1]}/version={version}"

    def _schema(self, name: str) -> T.StructType:
        more = T.DataType.fromDDL("part date, bucket int, version bigint")
        return T.StructType([*self.tables[name].schema.fields, *more.fields])

    def _log(self, name: str) -> DataFrame:
        path = f"{self._path(name)}_log"
        if name not in self._ready:
            if not exists(self.spark, path):
                self.spark.createDataFrame([], LOG).write.mode("append").parquet(f"{path}/at=0")
            self._ready.add(name)
        return self.spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(path)

    def _current(self, name: str) -> DataFrame:
        newest = self._log(name).filter("part IS NOT NULL").groupBy("part", "bucket")
        return newest.agg(F.max("version").alias("version"), F.max_by("present", "version").alias("present")).filter("present")

    def _versions(self, name: str, places: Iterable[Place]) -> dict[Place, list[tuple[int, bool]]]:
        wanted, found = set(places), defaultdict(list)
        days = sorted({day for day, _ in wanted})
        if days:
            for r in self._log(name).filter(F.col("part").isin(days)).collect():
                if (r.part, r.bucket) in wanted:
                    found[r.part, r.bucket].append((r.version, r.present))
        return {place: sorted(versions) for place, versions in found.items()}

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        schema = self._schema(name)
        if not folders:
            return self.spark.createDataFrame([], schema).drop("version")
        return self.spark.read.schema(schema).option("basePath", self._path(name)).parquet(*folders).drop("version")

    def applied(self, name: str, token: str) -> bool:
        return not self._log(name).filter(F.col("token") == token).isEmpty()

    # reading ----------------------------------------------------------------------------------

    def at(self, name: str, places: Iterable[Place]) -> DataFrame:
        """Stored rows of the given folders, with ``part`` and ``bucket``; no other folder is listed or read."""
        last = {place: versions[-1] for place, versions in self._versions(name, places).items()}
        return self._read(name, [self._folder(name, place, version) for place, (version, present) in last.items() if present])

    def between(self, name: str, first: dt.date, last: dt.date) -> DataFrame:
        """Stored rows of a closed range of days."""
        found = self._current(name).filter(F.col("part").between(first, last)).collect()
        return self._read(name, [self._folder(name, (r.part, r.bucket), r.version) for r in found])

    def table(self, name: str) -> DataFrame:
        """All stored rows."""
        if not exists(self.spark, self._path(name)):
            return self._read(name, []).drop("seconds", "part", "bucket")
        rows = self.spark.read.schema(self._schema(name)).parquet(self._path(name))
        current = self._current(name).select("part", "bucket", "version")
        return rows.join(current, ["part", "bucket", "version"], "left_semi").drop("seconds", "part", "bucket", "version")

    # writing ----------------------------------------------------------------------------------

    def replace(self, name: str, content: DataFrame, places: list[Place], token: str) -> bool:
        """``content`` (with ``part`` and ``bucket``) becomes all that the given folders hold, unless the token was applied."""
        if not places or self.applied(name, token):
            return False
        version = (self._log(name).agg(F.max("version")).first()[0] or 0) + 1
        columns = [f.name for f in self.tables[name].schema]
        # a crowded folder is split over several files by the rebalance
        content.select(*columns, "part", "bucket", F.lit(version).alias("version")).hint("rebalance", "part", "bucket").write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("part", "bucket", "version").parquet(self._path(name))
        before = self._versions(name, places)
        rows = [(day, bucket, version, exists(self.spark, self._folder(name, (day, bucket), version)), token) for day, bucket in places]
        self._commit(name, version, self.spark.createDataFrame(rows, LOG))
        for place, versions in before.items():
            if len(versions) > 1 and versions[-2][1]:
                remove(self.spark, self._folder(name, place, versions[-2][0]))
        return True

    def _commit(self, name: str, version: int, entries: DataFrame) -> None:
        path, old = f"{self._path(name)}_log", []
        if version % LOG_COMMITS == 0:
            newest = Window.partitionBy("part", "bucket").orderBy(F.col("version").desc())
            known = self._log(name).unionByName(entries)
            entries = known.withColumn("k", F.row_number().over(newest)).filter("k <= 2").drop("k")
            old = [f"{path}/at={v}" for v in range(version - LOG_COMMITS, version)]
        entries.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/at={version}")
        for folder in old:
            remove(self.spark, folder)

    # observations -----------------------------------------------------------------------------

    def merge_obs(
        self,
        batch: DataFrame,
        token: object,
        rule: Callable[[DataFrame, DataFrame], DataFrame] = write.upsert_override,
        around: int = 0,
    ) -> None:
        """The rule gets, and may change, the stored rows of the batch's days and of ``around`` days beside each."""
        places = _around(self.places("obs", batch), -around, around)
        merged = rule(self.at("obs", places), self.placed("obs", batch))
        self.replace("obs", merged, places, str(token))

    def recompute(self, batch: DataFrame, station: DataFrame, token: object) -> None:
        """Hourly and daily rows of exactly the buckets the batch touched, however late it came."""
        self.recompute_hours(write.touched_hour_buckets(batch), token)
        self.recompute_days(write.touched_day_buckets(batch, station), station, token)

    def recompute_hours(self, hours: DataFrame, token: object) -> None:
        """``hours`` are (station_id, datetime, is_daily)."""
        places = self.places("hourly", hours)
        # midnight readings of the next day close the last hour
        obs = self.at("obs", _around(places, 0, 1)).drop("part", "bucket")
        stored = self.at("hourly", places).drop("part", "bucket")
        self.replace("hourly", self.placed("hourly", write.recompute_hours(obs, hours, stored)), places, str(token))

    def recompute_days(self, days: DataFrame, station: DataFrame, token: object) -> None:
        """``days`` are (station_id, day, is_daily)."""
        places = self.places("daily", days)
        obs = self.at("obs", _around(places, -1, 1)).drop("part", "bucket")
        stored = self.at("daily", places).drop("part", "bucket")
        self.replace("daily", self.placed("daily", write.recompute_days(obs, station, days, stored)), places, str(token))


def _around(places: list[Place], before: int, after: int) -> list[Place]:
    return sorted({(day + dt.timedelta(days=k), bucket) for day, bucket in places for k in range(before, after + 1)})


class Arrivals:
    """Rows added batch by batch, in folders by day and batch; a batch that is run again replaces what it wrote."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, day: str = "to_date(datetime)"):
        self.spark, self.root, self.day, self.left_out = configure(spark), root, day, None
        self.schema = T.StructType([*schema.fields, *T.DataType.fromDDL("part date, batch string").fields])

    def _read(self) -> DataFrame:
        if not exists(self.spark, self.root):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.root)

    def add(self, rows: DataFrame, batch: str) -> None:
        rows.withColumns({"part": F.expr(self.day), "batch": F.lit(batch)}).hint("rebalance", "part").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("part", "batch").parquet(self.root)

    def others(self, days: list[dt.date], batch: str) -> DataFrame:
        """Rows of those days that other batches brought; both conditions prune folders."""
        return self._read().filter(F.col("part").isin(days) & (F.col("batch") != batch)).drop("part", "batch")

    def without(self, batch: str) -> Arrivals:
        """The same rows but for those of one batch."""
        out = Arrivals(self.spark, self.root, self.schema, self.day)
        out.schema, out.left_out = self.schema, batch
        return out

    def table(self) -> DataFrame:
        rows = self._read()
        if self.left_out is not None:
            rows = rows.filter(F.col("batch") != self.left_out)
        return rows.drop("part", "batch")


def snapshot_last24h(store: Store, as_of: str) -> DataFrame:
    """Last-day summary of the stored readings; only the two days it needs are read."""
    day = dt.datetime.fromisoformat(as_of).date()
    obs = store.between("obs", day - dt.timedelta(days=1), day).drop("part", "bucket")
    return summary.last24h_summary(obs, as_of)
