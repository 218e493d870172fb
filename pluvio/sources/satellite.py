"""Satellite platform messages: header, space text, comma text and pseudobinary payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import shift_seconds

# Variables of a space-text line, by position.
SPACE_TEXT_VARIABLES = [200, 0, 16, 14, 30, 50, 55, 53, 72, 60]
# Variables of a comma-text line, by position.
COMMA_TEXT_VARIABLES = [200, 4007, 0, 16, 14, 30, 51, 56, 53, 60, 72, 21]


def stamp(text: Column) -> Column:
    """``yyDDDHHmmss`` in UTC; two-digit years from 69 on belong to the last century."""

    def part(start: int, length: int) -> Column:
        return F.substring(text, start, length).try_cast("int")

    yy = part(1, 2)
    year = F.when(yy >= 69, yy + 1900).otherwise(yy + 2000)
    day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), part(3, 3) - 1)
    valid = part(3, 3).between(1, 366) & (part(6, 2) < 24) & (part(8, 2) < 60) & (part(10, 2) < 60)
    seconds = part(6, 2) * 3600 + part(8, 2) * 60 + part(10, 2)
    return F.when(valid, shift_seconds(day.cast("timestamp"), seconds))


def header_fields(header: Column) -> dict[str, Column]:
    def part(start: int, length: int) -> Column:
        return F.substring(header, start, length)

    return {
        "address": part(1, 8),
        "datetime": stamp(part(9, 11)),
        "failure_code": part(20, 1),
        "signal_strength": part(21, 2),
        "frequency_offset": part(23, 2),
        "modulation_index": part(25, 1),
        "data_quality": part(26, 1),
        "channel": part(27, 3),
        "spacecraft": part(30, 1),
        "source": part(31, 2),
        "length": part(33, 5),
    }


def decode_dcp_header(messages: DataFrame) -> DataFrame:
    """Header fields of ``(header, payload)``; a repeated (address, time) is kept once."""
    fields = header_fields(F.col("header"))
    parsed = messages.select(*[c.alias(n) for n, c in fields.items()], "payload").filter("datetime IS NOT NULL")
    rest = [c for c in parsed.columns if c not in ("address", "datetime")]
    # min of a struct keeps one whole row and combines before the shuffle
    return (
        parsed.groupBy("address", "datetime")
        .agg(F.min(F.struct(*rest)).alias("_m"))
        .select("address", "datetime", "_m.*")
    )


def _transmissions(responses: DataFrame, separator: str) -> DataFrame:
    """One row per transmission line of ``(station_id, address, response)``.

    The address differs per row; it is replaced by one mark first, so that splitting uses a fixed
    pattern that is compiled once.
    """
    mark = "\u0001"
    marked = F.replace(F.col("response"), F.col("address"), F.lit(mark))
    sent = responses.select("station_id", F.posexplode(F.split(marked, mark, -1)).alias("_n", "_t")).filter("_n > 0")
    return (
        sent.select("station_id", stamp(F.substring("_t", 1, 11)).alias("sent_at"), "_t")
        .filter("sent_at IS NOT NULL")
        .select("station_id", "sent_at", F.posexplode(F.split("_t", separator, -1)).alias("_n", "line"))
        .filter("_n > 0")
        .drop("_n")
    )


def _line_time(hhmm: Column) -> Column:
    """Time of a line on the day sent; an hour later than the sending hour is of the day before."""
    hour, minute = F.substring(hhmm, 1, 2).try_cast("int"), F.substring(hhmm, 3, 2).try_cast("int")
    day = F.date_trunc("day", "sent_at")
    seconds = hour * 3600 + minute * 60
    valid = (hour < 24) & (minute < 60)
    return F.when(valid, shift_seconds(day, F.when(hour > F.hour("sent_at"), seconds - 86400).otherwise(seconds)))


def _by_position(lines: DataFrame, values: Column, variables: list[int], intervals: DataFrame) -> DataFrame:
    """Values matched with the variable and the interval of their position (the first one is 1).

    The intervals are a few configured rows, one for each position in use; as an array beside the line's values
    they are applied before anything becomes a row.
    """
    slots: dict[int, list[int]] = {}
    for r in intervals.filter(F.col("position").between(1, len(variables))).select("position", "seconds").distinct().collect():
        slots.setdefault(r.position, []).append(r.seconds)

    def to(position: int) -> Column:
        known = [F.struct(F.lit(variables[position - 1]).alias("variable_id"), F.lit(s).cast("int").alias("seconds")) for s in slots.get(position, [])]
        return F.array(*known).cast("array<struct<variable_id:int,seconds:int>>")

    def cell(known: Column, value: Column) -> Column:
        filled = F.transform(known, lambda k: F.struct(k["variable_id"], k["seconds"], value.alias("measured")))
        return F.coalesce(F.filter(filled, lambda c: c["measured"].isNotNull()), none)

    none = F.array().cast("array<struct<variable_id:int,seconds:int,measured:double>>")
    layout = F.array(*[to(p) for p in range(1, len(variables) + 1)])
    return lines.select(
        "station_id", "datetime", F.inline(F.flatten(F.zip_with(layout, values, cell))).alias("variable_id", "seconds", "measured")
    ).select(
        "station_id",
        "variable_id",
        "seconds",
        "datetime",
        "measured",
        F.lit(None).cast("int").alias("quality_flag"),
        F.lit(False).alias("is_daily"),
    )


def decode_dcp_space_text(responses: DataFrame, intervals: DataFrame) -> DataFrame:
    """Lines ``HHMM v1 v2 ...``; what is no number is skipped."""
    lines = _transmissions(responses, " \r\n").withColumn("datetime", _line_time(F.col("line"))).filter("datetime IS NOT NULL")
    fields = F.split("line", " ", -1)
    values = F.transform(F.slice(fields, F.lit(2), F.lit(len(SPACE_TEXT_VARIABLES))), lambda text: text.try_cast("double"))
    return _by_position(lines, values, SPACE_TEXT_VARIABLES, intervals)


def decode_dcp_comma_text(responses: DataFrame, intervals: DataFrame) -> DataFrame:
    """Comma lines ``xHHMM,...``: two plain values, then tenths that may end in G or B; the closing
    field and the last value are not used."""
    lines = _transmissions(responses, "\r\n").filter(F.length("line") > 0)
    timed = lines.withColumn("datetime", _line_time(F.substring("line", 2, 4))).filter("datetime IS NOT NULL")
    fields = F.split("line", ",", -1)
    used = F.slice(F.col("_f"), F.lit(2), F.greatest(F.size("_f") - 3, F.lit(0)))

    def value(text: Column, k: Column) -> Column:
        tenths = F.regexp_replace(text, "[GB]$", "").try_cast("double") / 10
        return F.when(k < 2, text.try_cast("double")).otherwise(tenths)

    return _by_position(timed.withColumn("_f", fields), F.transform(used, value), COMMA_TEXT_VARIABLES, intervals)


def _character(c: Column) -> Column:
    code = F.ascii(c)
    return F.when(code == 63, F.lit(63)).otherwise(code - 64).cast("bigint")


def pseudobinary_value(chunk: Column) -> Column:
    """Three characters of six bits as an 18-bit two's complement number."""
    raw = (
        F.shiftleft(_character(F.substring(chunk, 1, 1)), 12)
        + F.shiftleft(_character(F.substring(chunk, 2, 1)), 6)
        + _character(F.substring(chunk, 3, 1))
    )
    sign = F.lit(0x20000).cast("bigint")
    negative = -((raw - 1).bitwiseXOR(F.lit(0x3FFFF).cast("bigint")))
    return F.when(raw.bitwiseAND(sign) == sign, negative).otherwise(raw)


def battery_volts(character: Column) -> Column:
    return (F.ascii(character) - 64) * F.lit(0.234) + F.lit(10.0)


def decode_pseudobinary(messages: DataFrame, elements: DataFrame, with_battery: bool = False) -> DataFrame:
    """Readings of ``(station_id, sent_at, payload)``.

    The payload starts with a mark, block id, group and minutes since the base time; then three
    characters per element. ``elements`` lists position, variable_id, divider, minutes back and
    seconds of each element.
    """
    body = F.substring(F.col("payload"), F.lit(5), F.length("payload"))
    if with_battery:
        body = F.substring(body, F.lit(1), F.length(body) - 1)
    minutes = F.ascii(F.substring("payload", 4, 1)) - 64
    rows = messages.select(
        "station_id", F.date_trunc("minute", shift_seconds("sent_at", -minutes * 60)).alias("base"), body.alias("_b")
    ).filter(F.length("_b") >= 3)
    count = F.floor(F.length("_b") / 3).cast("int")
    chunk = F.substring(F.col("_b"), F.col("position") * 3 - 2, F.lit(3))
    value = pseudobinary_value(F.col("chunk")).cast("double")
    return (
        rows.select("station_id", "base", "_b", F.explode(F.sequence(F.lit(1), count)).alias("position"))
        .withColumn("chunk", chunk)
        .filter("chunk <> '///'")
        .join(elements, "position")
        .select(
            "station_id",
            "variable_id",
            "seconds",
            shift_seconds("base", -F.col("minutes_back") * 60).alias("datetime"),
            F.when(F.col("divider") == 0, value).otherwise(value / F.col("divider")).alias("measured"),
            F.lit(None).cast("int").alias("quality_flag"),
            F.lit(False).alias("is_daily"),
        )
    )
