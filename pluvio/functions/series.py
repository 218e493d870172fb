"""Row-to-row work inside a series without putting a whole series into one task.

One station or variable may hold a large share of all rows, so a window partitioned by the series
key alone would run that share in a single task. The helpers cut each series into time blocks and
carry exactly what the next block needs, so results equal those of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.functions.columns import DAY_SECONDS, micros


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    order: str = "datetime",
    block_seconds: int = DAY_SECONDS,
    prefix: str = "prev_",
) -> DataFrame:
    """Add ``prev_<col>`` taken from the preceding row of the series (null on the first row).

    ``lag`` runs inside blocks; the first row of a block gets the last row of the nearest earlier
    non-empty block, found on one row per (series, block). Both branches read the same shuffle of
    the input, which Spark reuses, so the input itself is computed once. Rows of equal ``order`` follow
    each other by the other columns taken.
    """
    keys = list(keys)
    names = [order, *[c for c in cols if c != order]]
    row = F.struct(*names)
    by_block = [*keys, "_block"]
    blocked = df.withColumn("_block", F.floor(micros(order) / F.lit(block_seconds * 1_000_000)).cast("long"))
    lagged = blocked.withColumn("_prev", F.lag(row).over(Window.partitionBy(*by_block).orderBy(*names))).withColumn(
        "_last", F.max(row).over(Window.partitionBy(*by_block))
    )
    heads = lagged.filter("_prev IS NULL").withColumn(
        "_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))
    )
    stepped = lagged.filter("_prev IS NOT NULL").unionByName(heads)
    return stepped.select(
        *df.columns, *[F.col(f"_prev.{c}").alias(prefix + c) for c in names if c in cols or c == order]
    )


def sliding_max(
    df: DataFrame,
    keys: Sequence[str],
    width: Column,
    values: dict[str, Column],
    order: str = "datetime",
    ahead: bool = False,
) -> DataFrame:
    """Maximum of each value over the closed range [t - width, t] (or [t, t + width] when ``ahead``).

    ``width`` is in seconds and may differ per series. With blocks one width long the range is a
    part of the row's own block plus a part of one neighbouring block, so two running maxima over
    ordered blocks answer it: no per-width pass and no range self-join. Each row is shuffled twice
    (own block, neighbour) whatever the width.
    """
    step = -1 if ahead else 1
    blocks = Window.partitionBy(*keys, "_block")
    rising = blocks.orderBy(F.col("_at").asc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    falling = blocks.orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own_frame, halo_frame = (falling, rising) if ahead else (rising, falling)

    w = F.greatest(width.cast("long") * F.lit(1_000_000), F.lit(1).cast("long"))
    base = (
        df.withColumns({"_w": w, "_t": micros(order), **{f"_v_{n}": v for n, v in values.items()}})
        .withColumn("_b", F.floor(F.col("_t") / F.col("_w")).cast("long"))
        .withColumn("_row", F.struct(*[c for c in df.columns if c not in keys]))
    )
    # a row goes to its own block in full and to the neighbouring block with its values only
    own = F.struct(F.col("_b").alias("_block"), F.col("_t").alias("_at"), F.col("_row").alias("_row"))
    halo = F.struct(
        (F.col("_b") + step).alias("_block"),
        (F.col("_t") + F.lit(step) * F.col("_w")).alias("_at"),
        F.lit(None).cast(base.schema["_row"].dataType).alias("_row"),
    )
    rows = base.select(*keys, *[f"_v_{n}" for n in values], F.inline(F.array(own, halo)))
    is_own = F.col("_row").isNotNull()
    for name in values:
        rows = rows.withColumn(f"_o_{name}", F.max(F.when(is_own, F.col(f"_v_{name}"))).over(own_frame))
    for name in values:
        rows = rows.withColumn(f"_h_{name}", F.max(F.when(~is_own, F.col(f"_v_{name}"))).over(halo_frame))
    return rows.filter(is_own).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns],
        *[F.greatest(f"_o_{name}", f"_h_{name}").alias(name) for name in values],
    )


def complete_rolling_sum(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    previous_rows: int,
    span_seconds: int,
    order: str = "datetime",
    out: str = "acc",
) -> DataFrame:
    """Sum over a row and its ``previous_rows`` predecessors, kept where the oldest of them is less
    than ``span_seconds`` back.

    Only rows within the span can take part, so a block needs just the last ``span_seconds`` of the
    one before it.
    """
    block = max(span_seconds, DAY_SECONDS) * 1_000_000
    span = span_seconds * 1_000_000
    home = F.floor(F.col("_t") / F.lit(block)).cast("long")
    near_end = F.col("_t") >= (F.col("_home") + 1) * F.lit(block) - F.lit(span)
    blocks = F.when(near_end, F.array(F.col("_home"), F.col("_home") + 1)).otherwise(F.array("_home"))
    rows = (
        df.withColumn("_t", micros(order))
        .withColumn("_home", home)
        .select("*", F.explode(blocks).alias("_block"))
    )
    w = Window.partitionBy(*keys, "_block").orderBy("_t")
    return (
        rows.withColumn(out, F.sum(value).over(w.rowsBetween(-previous_rows, 0)))
        .withColumn("_oldest", F.lag("_t", previous_rows).over(w) if previous_rows else F.col("_t"))
        .filter((F.col("_block") == F.col("_home")) & (F.col("_t") - F.col("_oldest") < F.lit(span)))
        .select(*df.columns, out)
    )
