"""Joins of readings with per-key tables when one key may own a large share of the readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES = 8


def lookup(
    fact: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    spread: str | Sequence[str] = "datetime",
    extra: Column | None = None,
    copies: int = COPIES,
    shuffled: bool = False,
) -> DataFrame:
    """Left, inner or semi join with a table that holds few rows per key.

    No broadcast is asked for: Spark broadcasts the table when its measured size allows it. Otherwise
    each key is spread over ``copies`` partitions by a hash of ``spread``, with a copy of the table row
    in each. The salted key also gives the table a shuffle of its own even where it comes out of an
    aggregate on the same key, which is what lets adaptive execution split a partition that is still
    too large. ``extra`` is a further condition over columns of both sides.

    ``shuffled`` is for tables that may be large and whose rows come out of generators or windows: Spark
    takes their size from the few bytes they are made of, before the copies, and would send all of them to
    the driver and to every executor. They are joined by sorting, whatever that estimate.
    """
    columns = [spread] if isinstance(spread, str) else list(spread)
    salted = fact.withColumn("_salt", F.pmod(F.xxhash64(*columns), F.lit(copies)))
    named = {c: f"_on_{c}" for c in on}
    copied = table.withColumnsRenamed(named).withColumn(
        "_on_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint")))
    )
    if shuffled:
        copied = copied.hint("merge")
    condition = F.col("_salt") == F.col("_on_salt")
    for c in on:
        condition = condition & (F.col(c) == F.col(named[c]))
    if extra is not None:
        condition = condition & extra
    return salted.join(copied, condition, how).drop("_salt", "_on_salt", *named.values())
