"""Operators put together: files to checked readings, readings to every summary."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.joins import lookup
from pluvio.operators import qc, summary, write
from pluvio.session import cleaned, shared_dir, stored
from pluvio.sources import loggers, sheets
from pluvio.sources.lines import clean_line, csv_fields, file_name, first_field, unquoted
from pluvio.sources.manifest import ERROR, IN_PROCESS, PROCESSED, file_manifest_dedup

# decoders of text lines by format name
LINE_DECODERS: dict[str, Callable[[DataFrame, DataFrame, DataFrame], DataFrame]] = {
    "TOA5": loggers.ingest_logger_csv,
    "HOBO": loggers.ingest_hobo_csv,
    "WIDE": loggers.ingest_wide_csv,
}


def files_to_readings(
    lines: DataFrame,
    decoder: str,
    layout: DataFrame,
    station: DataFrame,
    variable: DataFrame,
    range_thr: DataFrame,
    step_thr: DataFrame,
) -> DataFrame:
    """Decoded and quality-controlled readings; ``layout`` is what the decoder maps names with."""
    if decoder not in LINE_DECODERS:
        raise ValueError(f"unknown decoder {decoder}")
    return qc.qc_ingest(LINE_DECODERS[decoder](lines, layout, station), range_thr, step_thr, station, variable)


def store_readings(target: DataFrame, batch: DataFrame, override: bool) -> DataFrame:
    rule = write.upsert_override if override else write.insert_ignore
    return rule(target, batch.select(*[c for c in batch.columns if c in target.columns]))


def all_summaries(obs: DataFrame, station: DataFrame) -> dict[str, DataFrame]:
    """Hourly from readings; daily once, with month and year rolled up from it."""
    daily = summary.daily_summary(obs, station)
    return {
        "hourly": summary.hourly_summary(obs),
        "daily": daily,
        "monthly": summary.monthly_summary(daily),
        "yearly": summary.yearly_summary(daily),
    }


# routing by the manifest ----------------------------------------------------------------------

READING = [
    ("station_id", "int"),
    ("variable_id", "int"),
    ("seconds", "int"),
    ("datetime", "timestamp"),
    ("measured", "double"),
    ("quality_flag", "int"),
    ("is_daily", "boolean"),
]


@dataclass(frozen=True)
class Dimensions:
    """What decoders map names with."""

    station: DataFrame
    variable: DataFrame
    logger_format: DataFrame
    hobo_format: DataFrame
    curves: DataFrame
    points: DataFrame


@dataclass(frozen=True)
class Decoder:
    """``header`` and ``data`` tell lines of a file apart, any other line that is not blank spoils the file (unless ``lenient``);
    ``code`` is the station code of a path, where the path has it; ``columns`` are those of a sheet, found by the names in its header."""

    decode: Callable[[DataFrame, Dimensions], DataFrame]
    header: Callable[[Column], Column]
    data: Callable[[Column], Column]
    code: Callable[[Column], Column] | None = None
    lenient: bool = False
    columns: tuple[str, ...] = ()


def _second(line: Column) -> Column:
    return unquoted(F.substring_index(F.substring_index(line, ",", 2), ",", -1))


def _names(header: Column) -> Column:
    return F.transform(csv_fields(header), lambda f: F.lower(unquoted(f)))


def _sheet(rows: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """Lines of sheets saved as CSV, as the columns named; ``slots`` are their places in the sheet, those that it lacks are blank."""
    fields = csv_fields(F.col("line"))
    data = rows.filter((first_field(F.col("line")) != "day") & F.col("slots").isNotNull())
    cells = data.withColumn("_f", F.transform(fields, unquoted))
    values = [F.coalesce(F.get("_f", F.get("slots", F.lit(k)) - 1), F.lit("")).alias(c) for k, c in enumerate(columns)]
    # as a generated row the columns are computed once; a plain select would be merged into every use of them
    return cells.select("path", *more, F.inline(F.array(F.struct(*values))))


RIVER_SHEET = ["day", "month", "level_6am", "level_6pm"]
DAILY_SHEET = ["day", "month", *sheets.DAILY_COLUMNS]
HOURLY_SHEET = ["day", "hour", "station_code", *sheets.SYNOPTIC_COLUMNS, *sheets.CLOUD_GROUPS, *sheets.PAST_WEATHER]


def _monthly(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sheets of a station and month; the manifest names the station."""
    return _sheet(rows, columns, "station_id").withColumn("month_start", F.to_date(F.concat("month", F.lit("-01"))))


def _is_int(text: Column) -> Column:
    return text.try_cast("int").isNotNull()


def _time(text: Column, pattern: str) -> Column:
    """Whether the text is a time; one without a mark of the pattern is none, which is cheaper to see than to try."""
    marked = F.lit(True)
    for mark in dict.fromkeys(c for c in pattern if not c.isalnum()):
        marked = marked & text.contains(mark)
    return F.when(marked, F.try_to_timestamp(text, F.lit(pattern)).isNotNull()).otherwise(F.lit(False))


def _path_code(path: Column) -> Column:
    return F.substring_index(file_name(path), "_", 1)


def _wide_code(path: Column) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(file_name(path), "_", 2), "_", -1), ".", 1)


def _is_day_header(line: Column) -> Column:
    return first_field(line) == "day"


DECODERS: dict[str, Decoder] = {
    "TOA5": Decoder(
        lambda rows, d: loggers.ingest_logger_csv(rows, d.logger_format, d.station),
        lambda line: first_field(line) == "TIMESTAMP",
        lambda line: first_field(line).isin("TOA5", "TS", "") | _time(first_field(line), "yyyy-MM-dd HH:mm:ss"),
        _path_code,
    ),
    "HOBO": Decoder(
        lambda rows, d: loggers.ingest_hobo_csv(rows, d.hobo_format, d.station),
        lambda line: line.contains("Date Time"),
        lambda line: line.contains("Plot Title:") | _time(_second(line), "MM/dd/yy hh:mm:ss a"),
    ),
    "SURFACE": Decoder(
        lambda rows, d: loggers.ingest_wide_csv(rows, d.variable, d.station),
        lambda line: line.startswith("datetime;"),
        lambda line: F.substring_index(line, ";", 1).try_cast("timestamp").isNotNull(),
        _wide_code,
    ),
    "HYDROLOGY": Decoder(
        lambda rows, d: sheets.ingest_river_sheet(_monthly(rows, RIVER_SHEET), d.station, d.curves, d.points),
        _is_day_header,
        lambda line: _is_int(first_field(line)),
        lenient=True,
        columns=tuple(RIVER_SHEET),
    ),
    "MANUAL DAILY": Decoder(
        lambda rows, d: sheets.ingest_daily_sheet(_monthly(rows, DAILY_SHEET), d.station),
        _is_day_header,
        lambda line: _is_int(first_field(line)),
        lenient=True,
        columns=tuple(DAILY_SHEET),
    ),
    "MANUAL HOURLY": Decoder(
        lambda rows, d: sheets.ingest_synoptic_hourly(_sheet(rows, HOURLY_SHEET), d.station),
        _is_day_header,
        lambda line: first_field(line).try_cast("date").isNotNull(),
        lenient=True,
        columns=tuple(HOURLY_SHEET),
    ),
}


@dataclass(frozen=True)
class Ingest:
    """Decoded readings, and (id, filepath, status_id, observation) of every waiting file. Lines are routed when readings are asked for."""

    states: DataFrame
    decode: Callable[[], DataFrame]

    @functools.cached_property
    def readings(self) -> DataFrame:
        return self.decode()


def _by_decoder(values: dict[str, Column]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(F.col("decoder") == name, value).otherwise(out)
    return out


def _spoilt(decoder: Decoder, line: Column) -> Column:
    return ~decoder.header(line) & ~decoder.data(line) & (F.trim(line) != "")


def _file_facts(lines: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Numbers of lines by file, of fixed width whatever the decoder; and header lines, and lines that are neither header nor data, by the
    decoder of a file."""
    line = F.col("line")
    kinds = list(dict.fromkeys(d.header for d in DECODERS.values()))
    strict = {name: F.count_if(_spoilt(d, line)) for name, d in DECODERS.items() if not d.lenient}
    counts = [F.count_if(header(line)).alias(f"_h{k}") for k, header in enumerate(kinds)]
    facts = lines.groupBy("path").agg(*counts, *[c.alias(f"_s{k}") for k, c in enumerate(strict.values())])
    headers = _by_decoder({name: F.col(f"_h{kinds.index(d.header)}") for name, d in DECODERS.items()})
    spoilt = _by_decoder({name: F.col(f"_s{k}") for k, name in enumerate(strict)})
    return facts, headers, spoilt


def _first_spoilt(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Of each file the first line by text that is neither header nor data; files are (path, decoder), few or many."""
    line = F.col("line")
    own = lookup(lines, files, ["path"], "inner", spread="line", copies=1)
    wrong = F.lit(False)
    for name, decoder in DECODERS.items():
        if not decoder.lenient:
            wrong = wrong | ((F.col("decoder") == name) & _spoilt(decoder, line))
    return own.filter(wrong).groupBy("path").agg(F.min(F.substring(line, 1, 200)).alias("spoilt"))


def ingest_by_decoder(manifest: DataFrame, lines: DataFrame, dims: Dimensions) -> Ingest:
    """Routes every waiting file of the manifest to the decoder it names, and says what became of it.

    ``manifest`` is (id, filepath, decoder, station_id, file_hash, status_id), ``lines`` are (path, line). Copies of files
    are skipped. A file fails by itself, with a reason and without any reading: its decoder is unknown, it has no lines, no header, a station that
    isn't known, or a line that is neither header nor data. Files are judged by numbers of their lines, before any line is moved; then the lines of
    good files are written once, by decoder, and a decoder reads its own only. Decisions and states are written too, as every decoder needs them;
    both have a row for each file, so they are never broadcast.
    """
    decided = file_manifest_dedup(manifest)
    queue = stored(decided.select("id", "filepath", "decoder", "station_id", "new_status_id"), "queue")
    chosen = queue.filter(F.col("new_status_id") == IN_PROCESS)
    text = lines.select("path", clean_line(F.col("line")).alias("line"))

    codes = dims.station.select(F.col("code").alias("_code"), F.lit(True).alias("_known"))
    named = _by_decoder({name: d.code(F.col("path")) for name, d in DECODERS.items() if d.code is not None})
    facts, headers, spoilt = _file_facts(text)
    by_path = Window.partitionBy("path")
    counted = (
        chosen.withColumnRenamed("filepath", "path")
        .join(facts.hint("merge"), "path", "left")
        # a path that comes twice is judged by the lines of both
        .select(
            *["id", "path", "decoder"],
            F.sum(headers).over(by_path).alias("headers"),
            F.sum(spoilt).over(by_path).alias("spoilt_lines"),
            named.alias("_code"),
        )
        .join(codes, "_code", "left")
    )
    known = F.col("decoder").isin(list(DECODERS))
    reason = (
        F.when(~known | F.col("decoder").isNull(), "unknown decoder")
        .when(F.col("headers").isNull(), "no such file, or an empty one")
        .when(F.col("headers") == 0, "no header")
        .when(F.col("_code").isNotNull() & F.col("_known").isNull(), F.concat(F.lit("unknown station "), "_code"))
    )
    judged = stored(counted.withColumn("reason", reason).select("id", "path", "decoder", "spoilt_lines", "reason"), "judged")
    # by the size of what is written Spark sees whether they are few
    wrong = stored(judged.filter("spoilt_lines > 0").select("path", "decoder").distinct(), "spoilt")
    texts = _first_spoilt(text, wrong)
    reason = F.coalesce("reason", F.concat(F.lit("not a line of data: "), "spoilt"))
    said = F.concat(F.lit('Error Processing file with "'), F.coalesce("decoder", F.lit("")), F.lit('" decoder. '), reason)
    found = judged.join(texts.hint("merge"), "path", "left").select(
        *["id", F.col("path").alias("filepath")],
        F.when(reason.isNull(), PROCESSED).otherwise(ERROR).alias("status_id"),
        F.substring(said, 1, 1024).alias("observation"),
    )
    done = stored(found, "states")
    skipped = queue.filter(F.col("new_status_id") != IN_PROCESS).select(
        "id", "filepath", F.col("new_status_id").alias("status_id"), F.lit(None).cast("string").alias("observation")
    )
    states = done.unionByName(skipped)
    return Ingest(states, lambda: _decoded(text, chosen, done, dims))


def _places(columns: tuple[str, ...]) -> Callable[[Column], Column]:
    """From names to the place of each column, from one on; zero where it is missing."""
    return lambda names: F.array(*[F.array_position(names, c).cast("int") for c in columns])


def _decoded(text: DataFrame, chosen: DataFrame, done: DataFrame, dims: Dimensions) -> DataFrame:
    """Readings of good files. With each line goes what its header says of the columns, so that sheets need no look-up of their own."""
    good = done.filter(F.col("status_id") == PROCESSED).select(F.col("filepath").alias("path"))
    files = chosen.select(F.col("filepath").alias("path"), "decoder", "station_id").join(good.hint("merge"), "path", "left_semi")
    heads = text.filter(_is_day_header(F.col("line"))).groupBy("path").agg(F.min("line").alias("_head"))
    # the names are an element of an array, so that they are found once and not for every column
    names = F.array(_names(F.col("_head")))
    found = {name: F.get(F.transform(names, _places(d.columns)), F.lit(0)) for name, d in DECODERS.items() if d.columns}
    named = files.join(heads.hint("merge"), "path", "left")
    slots = F.when(F.col("_head").isNotNull(), _by_decoder(found))
    placed = named.select("path", "decoder", "station_id", slots.alias("slots"))
    routed = lookup(text, placed, ["path"], "inner", spread="line", copies=1, shuffled=True)
    spark, folder = text.sparkSession, shared_dir(text.sparkSession, "routed")
    with cleaned(spark):
        routed.withColumn("part", F.col("decoder")).write.partitionBy("part").parquet(folder)
    kinds = "path string, line string, decoder string, station_id int, slots array<int>, part string"
    written = spark.read.schema(kinds).parquet(folder)
    readings = None
    for name, decoder in DECODERS.items():
        own = written.filter(F.col("part") == name).drop("part")
        rows = decoder.decode(own, dims).select(*[F.col(c).cast(kind).alias(c) for c, kind in READING])
        readings = rows if readings is None else readings.unionByName(rows)
    return readings
