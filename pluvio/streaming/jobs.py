"""Streaming jobs. Each returns a started query; callers choose the trigger and await it.

Late data is never lost: the jobs work through ``foreachBatch`` on stored tables, without a watermark. A batch reads
and replaces only the days and buckets it touches, so state is as large as what is late, not as what is
stored, and what it changes is applied once, also when the batch is run again.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pluvio.functions.columns import DAY_SECONDS
from pluvio.operators import qc, write
from pluvio.operators.summary import hourly_summary
from pluvio.plans import ingest
from pluvio.schema import KEY, SERIES
from pluvio.sources.lightning import FRAME_BYTES, decode_lightning_frames
from pluvio.sources.loggers import ingest_logger_csv
from pluvio.sources.manifest import NOT_PROCESSED, REPROCESS
from pluvio.streaming.store import Arrivals, Store, snapshot_last24h


def _start(writer, checkpoint: str, trigger: dict) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of new text files; a file always arrives whole in one micro-batch."""
    return (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )


def capture_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New capture files with their content."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .load(folder)
    )


def frames_of(files: DataFrame) -> DataFrame:
    """56-byte frames of capture files."""
    starts = F.sequence(F.lit(0), (F.length("content") / FRAME_BYTES).cast("int") - 1)
    cut = F.transform(starts, lambda i: F.substring("content", i * FRAME_BYTES + 1, F.lit(FRAME_BYTES)))
    return files.filter(F.length("content") >= FRAME_BYTES).select(F.explode(cut).alias("frame"))


def frame_stream(spark: SparkSession, folder: str) -> DataFrame:
    """56-byte frames of new capture files."""
    return frames_of(capture_stream(spark, folder))


def stream_file_ingest(
    lines: DataFrame,
    store: Store,
    var_format: DataFrame,
    station: DataFrame,
    variable: DataFrame,
    range_thr: DataFrame,
    step_thr: DataFrame,
    checkpoint: str,
    trigger: dict,
    rule: Callable[[DataFrame, DataFrame], DataFrame] = write.upsert_override,
) -> StreamingQuery:
    """Logger files to quality-controlled readings in the store.

    Steps are judged against the stored neighbours, and stored readings that follow a new one are judged again, so
    the flags depend neither on where batches are cut nor on the order of files.
    """

    limits = qc.station_limits(station, range=range_thr, step=step_thr)

    def handle(batch: DataFrame, batch_id: int) -> None:
        decoded = ingest_logger_csv(batch, var_format, station)
        # a logger may repeat a record; the unique key needs one row
        unique = decoded.groupBy(*KEY, "seconds").agg(
            F.max("measured").alias("measured"),
            F.max("quality_flag").alias("quality_flag"),
            F.max("is_daily").alias("is_daily"),
            F.lit(None).cast("string").alias("code"),
        )
        checked = qc.qc_ingest(unique, range_thr, step_thr, station, variable, limits).select(*unique.columns).persist()

        merged: list[DataFrame] = []

        def judged(stored: DataFrame, new: DataFrame) -> DataFrame:
            # read by several branches of the judgement
            merged.append(rule(stored, new).persist())
            return qc.rejudge(merged[0], new, range_thr, step_thr, station, variable, limits)

        try:
            longest = checked.agg(F.max("seconds")).first()[0] or 0
            store.merge_obs(checked, f"{checkpoint}:{batch_id}", judged, around=1 + longest // DAY_SECONDS)
        finally:
            for df in (checked, *merged):
                df.unpersist()

    return _start(lines.writeStream.foreachBatch(handle), checkpoint, trigger)


# Rows of the states that files came to, batch by batch.
STATES = "id bigint, filepath string, status_id int, observation string, batch_id bigint"


def with_states(manifest: DataFrame, states: Arrivals) -> DataFrame:
    """The manifest with the state and the reason each file has now."""
    known = states.table().groupBy("id").agg(F.max(F.struct("batch_id", "status_id", "observation")).alias("_s"))
    return manifest.join(known, "id", "left").select(
        *[c for c in manifest.columns if c not in ("status_id", "observation")],
        F.coalesce("_s.status_id", "status_id").alias("status_id"),
        F.col("_s.observation").alias("observation"),
    )


def stream_ingest_by_decoder(
    lines: DataFrame,
    manifest: Callable[[], DataFrame],
    states: Arrivals,
    store: Store,
    dims: ingest.Dimensions,
    limits: DataFrame,
    checkpoint: str,
    trigger: dict,
    rule: Callable[[DataFrame, DataFrame], DataFrame] = write.upsert_override,
) -> StreamingQuery:
    """New files to checked readings, each by the decoder that the manifest names; states and reasons go to ``states``.

    A file that fails leaves no reading and stops no other. Readings are stored before states are written, both by batch: one that
    is run again ends in the same state. Copies of files that a former batch read are skipped.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        name = f"{sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}"
        here = batch.select(F.col("path").alias("filepath")).distinct()
        known = with_states(manifest(), states.without(name))
        waiting = F.col("status_id").isin(NOT_PROCESSED, REPROCESS)
        # other waiting files are left to the batch that brings them
        own = known.join(here.withColumn("_here", F.lit(True)), "filepath", "left").filter(~waiting | F.col("_here")).drop("_here")
        found = ingest.ingest_by_decoder(own, batch, dims)
        unique = found.readings.groupBy(*KEY, "seconds").agg(
            F.max("measured").alias("measured"),
            F.max("quality_flag").alias("quality_flag"),
            F.max("is_daily").alias("is_daily"),
            F.lit(None).cast("string").alias("code"),
        )
        one = unique.groupBy(*KEY).agg(F.max(F.struct(*[c for c in unique.columns if c not in KEY])).alias("_r")).select(*KEY, "_r.*")
        checked = qc.qc_tests(one, limits, dims.variable).withColumn("quality_flag", qc.ingest_flag()).select(*one.columns).persist()
        try:
            store.merge_obs(checked, f"{checkpoint}:{batch_id}", rule)
            states.add(found.states.withColumn("batch_id", F.lit(batch_id).cast("bigint")), name)
        finally:
            checked.unpersist()

    return _start(lines.writeStream.foreachBatch(handle), checkpoint, trigger)


def stream_dirty_recompute(
    readings: DataFrame,
    store: Store,
    station: DataFrame,
    checkpoint: str,
    trigger: dict,
    unique: Callable[[DataFrame], DataFrame],
    rule: Callable[[DataFrame, DataFrame], DataFrame] = write.insert_ignore,
) -> StreamingQuery:
    """Readings to the store, then the summaries of every bucket they touched."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        # read by the merge and by both summaries; a lost executor only means reading it again
        rows = unique(batch).persist()
        try:
            store.merge_obs(rows, f"{checkpoint}:{batch_id}", rule)
            store.recompute(rows, station, f"{checkpoint}:{batch_id}")
        finally:
            rows.unpersist()

    return _start(readings.writeStream.foreachBatch(handle), checkpoint, trigger)


def stream_last24h(
    readings: DataFrame,
    store: Store,
    as_of: Callable[[], str],
    out: str,
    checkpoint: str,
    trigger: dict,
    unique: Callable[[DataFrame], DataFrame],
) -> StreamingQuery:
    """Readings to the store and a fresh last-day snapshot after each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = unique(batch).persist()
        try:
            store.merge_obs(rows, f"{checkpoint}:{batch_id}", write.insert_ignore)
            snapshot_last24h(store, as_of()).write.mode("overwrite").parquet(out)
        finally:
            rows.unpersist()

    return _start(readings.writeStream.foreachBatch(handle), checkpoint, trigger)


def stream_hourly_window(readings: DataFrame, store: Store, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Hourly summary kept complete: a batch's partial figures are merged into the stored hours it touches.

    Every reading counts once, as it comes; a stream with repeated readings goes through ``stream_dedup`` first.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        partial = store.placed("hourly", hourly_summary(batch)).persist()
        try:
            places = [(r.part, r.bucket) for r in partial.select("part", "bucket").distinct().collect()]
            both = store.at("hourly", places).unionByName(partial)
            merged = both.groupBy("part", "bucket", *SERIES, "datetime", "is_daily").agg(
                F.min("min_value").alias("min_value"),
                F.max("max_value").alias("max_value"),
                F.try_divide(F.sum("sum_value"), F.sum("num_records")).alias("avg_value"),
                F.sum("sum_value").alias("sum_value"),
                F.sum("num_records").alias("num_records"),
            )
            store.replace("hourly", merged, places, f"{checkpoint}:{batch_id}")
        finally:
            partial.unpersist()

    return _start(readings.writeStream.foreachBatch(handle), checkpoint, trigger)


def stream_dedup(readings: DataFrame, out: Arrivals, checkpoint: str, trigger: dict) -> StreamingQuery:
    """First arrival of each key, however long ago; of equal keys in one batch the least row by its other columns.

    A batch is compared with the stored keys of the days it brings, and only adds rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows, name = batch.persist(), f"{sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}"
        try:
            rest = [c for c in rows.columns if c not in KEY]
            first = rows.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("_r")).select(*KEY, "_r.*")
            days = [r[0] for r in rows.select(F.to_date("datetime")).distinct().collect()]
            out.add(first.join(out.others(days, name).select(*KEY), KEY, "left_anti"), name)
        finally:
            rows.unpersist()

    return _start(readings.writeStream.foreachBatch(handle), checkpoint, trigger)


def stroke_counts(
    frames: DataFrame, width: str = "1 hour", area: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Strokes per type and window, all or those inside the area."""
    return (
        decode_lightning_frames(frames, area=area)
        .groupBy(F.window("datetime", width).alias("_w"), "type")
        .agg(F.count(F.lit(1)).alias("strokes"), F.max(F.abs("peak_current")).alias("strongest"))
        .select(F.col("_w.start").alias("window_start"), "type", "strokes", "strongest")
    )


def stream_lightning(
    files: DataFrame,
    store: Store,
    checkpoint: str,
    trigger: dict,
    width: str = "1 hour",
    area: tuple[float, float, float, float] | None = None,
) -> StreamingQuery:
    """Counts of capture files, complete in any order of files; a file counts once, by its content.

    The counts of a batch are merged into the stored windows first, then its files are named. A batch that fails in
    between finds its counts applied, and only names the files. Files are looked for under the day of their first frame.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        token = f"{checkpoint}:{batch_id}"
        seconds = F.conv(F.hex(F.substring("content", 3, 4)), 16, 10).cast("long")
        day = F.coalesce(F.to_date(F.timestamp_seconds(seconds)), F.lit(dt.date(1970, 1, 1)))
        named = batch.select("path", "content", F.sha2("content", 256).alias("digest"), day.alias("first_day"))
        distinct = named.groupBy("digest", "first_day").agg(F.min("path").alias("path"))
        ledger = store.placed("files", distinct).persist()
        try:
            places = [(r.part, r.bucket) for r in ledger.select("part", "bucket").distinct().collect()]
            known = store.at("files", places)
            new = ledger.join(known.select("digest"), "digest", "left_anti").persist()
            if not store.applied("strokes", token):
                own = batch.select("path", "content").join(new.select("path"), "path", "left_semi")
                counts = store.placed("strokes", stroke_counts(frames_of(own), width, area)).persist()
                touched = [(r.part, r.bucket) for r in counts.select("part", "bucket").distinct().collect()]
                merged = (
                    store.at("strokes", touched)
                    .unionByName(counts)
                    .groupBy("part", "bucket", "window_start", "type")
                    .agg(F.sum("strokes").alias("strokes"), F.max("strongest").alias("strongest"))
                )
                store.replace("strokes", merged, touched, token)
                counts.unpersist()
            store.replace("files", known.unionByName(new), places, token)
            new.unpersist()
        finally:
            ledger.unpersist()

    return _start(files.writeStream.foreachBatch(handle), checkpoint, trigger)


def append_to(df: DataFrame, out: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Append-mode file sink, exactly once through its checkpoint."""
    return _start(df.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, trigger)
