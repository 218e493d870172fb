"""Column expressions shared by the operators: value rules, flags, time buckets, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
MISSING = -99.9
MISSING_CODE = "/"
NOT_CHECKED, SUSPICIOUS, BAD, GOOD = 1, 2, 3, 4
DAY_SECONDS = 86400

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts(text: str) -> Column:
    """Timestamp literal written in UTC."""
    return F.to_timestamp(F.lit(text))


# values and flags ---------------------------------------------------------------------------


def effective_value() -> Column:
    return F.coalesce(F.col("consisted"), F.col("measured"))


def accepted() -> Column:
    """The manual flag decides where present, else the automatic one; 1 and 4 pass."""
    return F.coalesce(F.col("manual_flag"), F.col("quality_flag")).isin(NOT_CHECKED, GOOD)


def not_missing(value: ColumnOrName) -> Column:
    return col(value) != F.lit(MISSING)


def is_coded(variable_type: ColumnOrName = "variable_type") -> Column:
    return F.lower(col(variable_type)) == "code"


def pick_listing(op: ColumnOrName = "sampling_operation_id") -> Column:
    """Summary figure shown in lists and exports."""
    op = col(op)
    return (
        F.when(op.isin(1, 2), F.col("avg_value"))
        .when(op == 3, F.col("min_value"))
        .when(op == 4, F.col("max_value"))
        .otherwise(F.col("sum_value"))
    )


def pick_report(op: ColumnOrName = "sampling_operation_id") -> Column:
    """Summary figure shown in reports and maps."""
    op = col(op)
    return (
        F.when(op.isin(6, 7), F.col("sum_value"))
        .when(op == 3, F.col("min_value"))
        .when(op == 4, F.col("max_value"))
        .otherwise(F.col("avg_value"))
    )


def pick_last24(op: ColumnOrName = "sampling_operation_id") -> Column:
    op = col(op)
    return (
        F.when(op == 1, F.col("latest_value"))
        .when(op == 2, F.col("avg_value"))
        .when(op == 3, F.col("min_value"))
        .when(op == 4, F.col("max_value"))
        .when(op == 6, F.col("sum_value"))
    )


def pick_current_day(op: ColumnOrName = "sampling_operation_id") -> Column:
    op = col(op)
    return (
        F.when(op.isin(1, 2), F.col("avg_value"))
        .when(op == 3, F.col("min_value"))
        .when(op == 4, F.col("max_value"))
        .when(op == 6, F.col("sum_value"))
    )


# rounding -----------------------------------------------------------------------------------


def round_half_up(x: ColumnOrName, digits: int) -> Column:
    """Decimal rounding, half away from zero.

    Rounding the double itself would depend on how 1.005 is stored; ten decimals first settle that.
    """
    return F.round(col(x).cast("decimal(28,10)"), digits).cast("double")


def round_half_even(x: ColumnOrName, digits: int) -> Column:
    """Decimal rounding with exact ties to the even neighbour, as lists, reports and extremes show it."""
    return F.bround(col(x).cast("decimal(28,10)"), digits).cast("double")


def trunc_to(x: ColumnOrName, digits: int) -> Column:
    """Cut off after ``digits`` decimals (non-negative input)."""
    scale = 10**digits
    return F.floor(col(x).cast("decimal(28,10)") * F.lit(scale)).cast("double") / F.lit(float(scale))


# time ---------------------------------------------------------------------------------------


def micros(c: ColumnOrName) -> Column:
    return F.unix_micros(col(c))


def seconds_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return ((micros(later) - micros(earlier)) / F.lit(1_000_000)).cast("long")


def shift_minutes(c: ColumnOrName, minutes: ColumnOrName) -> Column:
    return F.timestamp_micros(micros(c) + col(minutes).cast("long") * F.lit(60_000_000))


def shift_seconds(c: ColumnOrName, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(micros(c) + seconds.cast("long") * F.lit(1_000_000))


def to_local(c: ColumnOrName, offset_minutes: ColumnOrName = "utc_offset_minutes") -> Column:
    return shift_minutes(c, offset_minutes)


def to_utc(c: ColumnOrName, offset_minutes: ColumnOrName = "utc_offset_minutes") -> Column:
    return shift_minutes(c, -col(offset_minutes))


def at_midnight(c: ColumnOrName) -> Column:
    return col(c) == F.date_trunc("day", col(c))


def hour_bucket(c: ColumnOrName = "datetime") -> Column:
    """Hour of a reading; exact midnight closes hour 23 of the day before."""
    return F.when(at_midnight(c), F.date_trunc("hour", shift_seconds(c, -1))).otherwise(F.date_trunc("hour", col(c)))


def local_day(
    c: ColumnOrName = "datetime", offset: ColumnOrName = "utc_offset_minutes", is_daily: ColumnOrName = "is_daily"
) -> Column:
    """Local calendar day; right-closed for sub-daily readings, plain for daily ones."""
    local = to_local(c, offset)
    return F.when(col(is_daily), F.to_date(local)).otherwise(F.to_date(shift_seconds(local, -1)))


def day_of_week(d: ColumnOrName) -> Column:
    """Sunday = 0."""
    return F.dayofweek(col(d)) - 1


def parse_iso_z(text: ColumnOrName) -> Column:
    """ISO text with a trailing Z, with or without fractional seconds."""
    return F.coalesce(
        F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.try_to_timestamp(col(text), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")),
    )


def number_or_null(text: ColumnOrName) -> Column:
    """Numeric text as double; blank and other text become null."""
    return F.nullif(F.trim(col(text)), F.lit("")).try_cast("double")


def slug(text: ColumnOrName) -> Column:
    return F.replace(F.lower(col(text)), F.lit(" "), F.lit("-"))


def positive_degrees(radians: ColumnOrName) -> Column:
    return F.pmod(F.degrees(col(radians)), F.lit(360.0))
