"""Quality control: threshold look-up chains, range, step and persistence tests, flag rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.columns import (
    BAD,
    GOOD,
    MISSING,
    NOT_CHECKED,
    SUSPICIOUS,
    is_coded,
    seconds_between,
    shift_seconds,
    ts,
)
from pluvio.functions.joins import lookup
from pluvio.functions.series import sliding_max, with_previous
from pluvio.schema import KEY, SERIES
from pluvio.session import stored

# Messages stored with a flag.
NOT_FOUND = "Threshold not found"
NO_NEIGHBOUR = "Consecutive value not present"
CUSTOM_EXACT = "Custom station Threshold"
CUSTOM_ANY_RANGE = "Custom station threshold"
REFERENCE = "Reference station threshold"
GLOBAL_AUTOMATIC = "Global threshold (Automatic)"
GLOBAL_MANUAL = "Global threshold (Manual)"


# threshold chains -----------------------------------------------------------------------------


def _station_part(station: DataFrame) -> DataFrame:
    return station.select(F.col("id").alias("station_id"), "reference_station_id", "is_automatic")


def _variable_part(variable: DataFrame, *columns: str) -> DataFrame:
    return variable.select(F.col("id").alias("variable_id"), *[F.col(c).alias(f"_{c}") for c in columns])


# the chain, in order: whose threshold, for exactly the interval or for any, name of the hit
STEPS = [
    ("station_id", True, "_own_exact"),
    ("station_id", False, "_own_any"),
    ("reference_station_id", True, "_ref_exact"),
    ("reference_station_id", False, "_ref_any"),
]


def _attempt(
    rows: DataFrame, thr: DataFrame, owner: str, exact: bool, detail: list[str], limits: list[str], name: str
) -> DataFrame:
    """One look-up in the threshold table; its limits arrive as the struct ``name``.

    The table is joined as it is stored: Spark knows its size, broadcasts it when small and otherwise
    can split the partitions of a crowded station, which it cannot for a table that was joined before.
    """
    on = ["variable_id", *(["interval"] if exact else []), *detail]
    side = thr.filter(F.col("interval").isNotNull() if exact else F.col("interval").isNull()).select(
        F.col("station_id").alias("_k_station"), *[F.col(c).alias(f"_k_{c}") for c in on], F.struct(*limits).alias(name)
    )
    condition = F.col(owner) == F.col("_k_station")
    for c in on:
        condition = condition & (F.col(c) == F.col(f"_k_{c}"))
    return rows.join(side, condition, "left").drop("_k_station", *[f"_k_{c}" for c in on])


def _levels(thr: DataFrame, detail: str | None, limits: list[str], name: str) -> DataFrame:
    """One row for each owner: a map from variable (and ``detail``) to its limits by interval, and those for any interval."""
    keys = ["station_id", "variable_id", *([detail] if detail else [])]
    known = thr.dropna(subset=keys).groupBy(*keys, "interval").agg(F.min(F.struct(*limits)).alias("limits"))
    exact = F.when(F.col("interval").isNotNull(), F.struct("interval", "limits"))
    level = F.struct(
        F.map_from_entries(F.collect_list(exact)).alias("exact"),
        F.max(F.when(F.col("interval").isNull(), F.col("limits"))).alias("any"),
    )
    rows = known.groupBy(*keys).agg(level.alias("level"))
    for key in reversed(keys[1:]):
        keys = keys[:-1]
        rows = rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(key, "level"))).alias("level"))
    return rows.withColumnRenamed("level", name)


# by kind: what the limits depend on beside series and interval, and their names
KINDS = {
    "range": ("month", ["range_min", "range_max"]),
    "step": (None, ["step_min", "step_max"]),
    "persist": ("window", ["minimum_variance"]),
}


def station_limits(station: DataFrame, **thr: DataFrame) -> DataFrame:
    """Thresholds resolved once: a row for each station with its own limits and those of its reference station.

    ``thr`` names kinds of thresholds (range, step, persist). The table holds dimensions only; written to the shared folder, its size
    is known to Spark, and readings need one look-up whatever the steps of the chain.
    """
    rows = _station_part(station)
    for kind, table in thr.items():
        own = _levels(table, *KINDS[kind], f"_{kind}_own")
        rows = rows.join(own, "station_id", "full_outer")
        named = {"station_id": "reference_station_id", f"_{kind}_own": f"_{kind}_ref"}
        rows = rows.join(own.withColumnsRenamed(named), "reference_station_id", "left")
    return stored(rows.drop("reference_station_id"), "limits")


def _with_limits(rows: DataFrame, limits: DataFrame, variable: DataFrame, *columns: str) -> DataFrame:
    """Rows with their station's limits and columns of their variable."""
    return rows.join(limits, "station_id", "left").join(_variable_part(variable, *columns), "variable_id", "left")


def _found(kind: str, messages: list[str], detail: Column | None, interval: Column) -> tuple[Column, Column]:
    """First hit of: own station exact, own station any interval, reference exact, reference any interval; and its message."""
    hits = []
    for owner in ("own", "ref"):
        level = F.try_element_at(F.col(f"_{kind}_{owner}"), F.col("variable_id"))
        if detail is not None:
            level = F.try_element_at(level, detail)
        hits += [F.try_element_at(level["exact"], interval), level["any"]]
    return F.coalesce(*hits), F.coalesce(*[F.when(h.isNotNull(), F.lit(m)) for h, m in zip(hits, messages)])


def _range_limits(rows: DataFrame, interval: str = "interval", month: Column | None = None) -> DataFrame:
    """Adds the range limits; the variable's own ones come last."""
    messages = [CUSTOM_EXACT, CUSTOM_ANY_RANGE, REFERENCE, REFERENCE]
    hit, source = _found("range", messages, F.col("month") if month is None else month, F.col(interval))
    auto, known = F.col("is_automatic"), F.col("_hit").isNotNull()

    def limit(name: str) -> Column:
        return F.when(known, F.col(f"_hit.{name}")).when(auto, F.col(f"_{name}_hourly")).when(~auto, F.col(f"_{name}"))

    return (
        rows.withColumns({"_hit": hit, "_source": source})
        .withColumns(
            {
                "range_min": limit("range_min"),
                "range_max": limit("range_max"),
                "range_description": F.coalesce("_source", F.when(auto, GLOBAL_AUTOMATIC).when(~auto, GLOBAL_MANUAL)),
            }
        )
        .drop("_hit", "_source")
    )


def _step_limits(rows: DataFrame, interval: str = "interval") -> DataFrame:
    """Adds the step limits; the global rule is plus/minus one step, if any."""
    hit, source = _found("step", [CUSTOM_EXACT, CUSTOM_EXACT, REFERENCE, REFERENCE], None, F.col(interval))
    auto, known = F.col("is_automatic"), F.col("_hit").isNotNull()
    size = F.when(auto, F.col("_step_hourly")).when(~auto, F.col("_step"))
    overall = F.when(size.isNotNull() & auto, GLOBAL_AUTOMATIC).when(size.isNotNull(), GLOBAL_MANUAL)
    return (
        rows.withColumns({"_hit": hit, "_source": source})
        .withColumns(
            {
                "step_min": F.when(known, F.col("_hit.step_min")).otherwise(-size),
                "step_max": F.when(known, F.col("_hit.step_max")).otherwise(size),
                "step_description": F.coalesce("_source", overall),
            }
        )
        .drop("_hit", "_source")
    )


RANGE_COLUMNS = ["range_min", "range_max", "range_min_hourly", "range_max_hourly"]
STEP_COLUMNS = ["step", "step_hourly"]


def resolve_range_threshold(keys: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame) -> DataFrame:
    """Limits for rows with (station, variable, interval, month); the variable's own limits come last."""
    rows = _range_limits(_with_limits(keys, station_limits(station, range=thr), variable, *RANGE_COLUMNS))
    return rows.select(*keys.columns, "range_min", "range_max", "range_description")


def resolve_step_threshold(keys: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame) -> DataFrame:
    """Limits for rows with (station, variable, interval); the global rule is plus/minus one step, if any."""
    rows = _step_limits(_with_limits(keys, station_limits(station, step=thr), variable, *STEP_COLUMNS))
    return rows.select(*keys.columns, "step_min", "step_max", "step_description")


def resolve_persist_threshold(keys: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame) -> DataFrame:
    """Smallest variation for (station, variable, interval, window); nothing for a zero window or interval."""
    rows = _with_limits(keys, station_limits(station, persist=thr), variable, "persistence", "persistence_hourly")
    hit, source = _found(
        "persist", [CUSTOM_EXACT, CUSTOM_EXACT, REFERENCE, REFERENCE], F.col("window").cast("int"), F.col("interval")
    )
    auto = F.col("is_automatic")
    usable = (F.col("window") != 0) & (F.col("interval") != 0)
    limit = F.when(F.col("_hit").isNotNull(), F.col("_hit.minimum_variance")).otherwise(
        F.when(auto, F.col("_persistence_hourly")).when(~auto, F.col("_persistence"))
    )
    overall = F.when(auto, F.lit(GLOBAL_AUTOMATIC)).when(~auto, F.lit(GLOBAL_MANUAL))
    return rows.withColumns({"_hit": hit, "_source": source}).select(
        *keys.columns,
        F.when(usable, limit).alias("persist_min"),
        F.when(usable, F.coalesce("_source", overall)).alias("persist_description"),
    )


# tests ----------------------------------------------------------------------------------------


def range_flag() -> Column:
    found = F.col("range_min").isNotNull() & F.col("range_max").isNotNull()
    return F.when(~found, NOT_CHECKED).when(
        F.col("measured").between(F.col("range_min"), F.col("range_max")), GOOD
    ).otherwise(BAD)


def range_message() -> Column:
    found = F.col("range_min").isNotNull() & F.col("range_max").isNotNull()
    return F.when(~found, NOT_FOUND).otherwise(F.col("range_description"))


def step_flag() -> Column:
    found = F.col("step_min").isNotNull() & F.col("step_max").isNotNull()
    return (
        F.when(~found, NOT_CHECKED)
        .when(~F.col("seconds").eqNullSafe(F.col("diff_seconds")), NOT_CHECKED)
        .when(F.col("diff_value").between(F.col("step_min"), F.col("step_max")), GOOD)
        .otherwise(BAD)
    )


def step_message() -> Column:
    found = F.col("step_min").isNotNull() & F.col("step_max").isNotNull()
    return (
        F.when(~found, NOT_FOUND)
        .when(~F.col("seconds").eqNullSafe(F.col("diff_seconds")), NO_NEIGHBOUR)
        .otherwise(F.col("step_description"))
    )


def ingest_flag(step: str = "qc_step_quality_flag", range_: str = "qc_range_quality_flag") -> Column:
    s, r = F.col(step), F.col(range_)
    return (
        F.when((s == BAD) | (r == BAD), BAD).when(s == NOT_CHECKED, r).when(r == NOT_CHECKED, s).otherwise(GOOD)
    )


def final_flag() -> Column:
    """Worst counts first, but one good test outranks a suspicious one."""
    flags = F.array("qc_persist_quality_flag", "qc_range_quality_flag", "qc_step_quality_flag")
    return (
        F.when(F.array_contains(flags, BAD), BAD)
        .when(F.array_contains(flags, GOOD), GOOD)
        .when(F.array_contains(flags, SUSPICIOUS), SUSPICIOUS)
        .otherwise(NOT_CHECKED)
    )


def _range_tested(rows: DataFrame) -> DataFrame:
    """Range flag and message of readings that carry their limits."""
    limited = _range_limits(rows, "seconds", F.month("datetime"))
    return limited.withColumns({"qc_range_quality_flag": range_flag(), "qc_range_description": range_message()}).drop(
        "range_min", "range_max", "range_description"
    )


def _step_tested(rows: DataFrame) -> DataFrame:
    """Step flag and message of readings that carry their limits and differences."""
    limited = _step_limits(rows, "seconds")
    return limited.withColumns({"qc_step_quality_flag": step_flag(), "qc_step_description": step_message()}).drop(
        "step_min", "step_max", "step_description"
    )


RANGE_RESULT = ["qc_range_quality_flag", "qc_range_description"]
STEP_RESULT = ["qc_step_quality_flag", "qc_step_description"]


def qc_range_test(batch: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame) -> DataFrame:
    """Inclusive range test against the limits of the reading's month."""
    rows = _with_limits(batch, station_limits(station, range=thr), variable, *RANGE_COLUMNS)
    return _range_tested(rows).select(*batch.columns, *RANGE_RESULT)


def step_differences(batch: DataFrame) -> DataFrame:
    """Change of value and time since the previous reading of the same series, interval and month."""
    rows = batch.withColumn("_month", F.month("datetime"))
    stepped = with_previous(rows, [*SERIES, "seconds", "_month"], ["measured"])
    return stepped.withColumn("diff_value", F.col("measured") - F.col("prev_measured")).withColumn(
        "diff_seconds", F.coalesce(seconds_between("datetime", "prev_datetime"), F.lit(0))
    ).select(*batch.columns, "diff_value", "diff_seconds")


def _stepped(batch: DataFrame, last_stored: DataFrame | None) -> DataFrame:
    """Differences inside the batch; ``last_stored`` rows may be put in front of each series."""
    rows = batch.withColumn("_new", F.lit(True))
    if last_stored is not None:
        rows = rows.unionByName(last_stored.withColumn("_new", F.lit(False)), allowMissingColumns=True)
    return step_differences(rows).filter("_new")


def qc_step_test(
    batch: DataFrame,
    thr: DataFrame,
    station: DataFrame,
    variable: DataFrame,
    last_stored: DataFrame | None = None,
) -> DataFrame:
    """Step test inside the batch; ``last_stored`` rows may be put in front of each series."""
    rows = _with_limits(_stepped(batch, last_stored), station_limits(station, step=thr), variable, *STEP_COLUMNS)
    return _step_tested(rows).select(*batch.columns, *STEP_RESULT)


def qc_tests(
    batch: DataFrame,
    limits: DataFrame,
    variable: DataFrame,
    last_stored: DataFrame | None = None,
) -> DataFrame:
    """Range and step tests with one look-up of limits a reading; ``limits`` are those of ``station_limits``."""
    rows = _with_limits(_stepped(batch, last_stored), limits, variable, *RANGE_COLUMNS, *STEP_COLUMNS)
    return _step_tested(_range_tested(rows)).select(*batch.columns, *RANGE_RESULT, *STEP_RESULT)


def qc_ingest(
    batch: DataFrame,
    range_thr: DataFrame,
    step_thr: DataFrame,
    station: DataFrame,
    variable: DataFrame,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Range and step tests with the combined flag; coded readings skip them and carry no number.

    A stream passes its ``limits``, so that they are resolved once and not in every batch.
    """
    limits = station_limits(station, range=range_thr, step=step_thr) if limits is None else limits
    known = variable.withColumn("coded", is_coded())
    # a coded reading is no neighbour of the numeric ones: its series has no others
    rows = _with_limits(_stepped(batch, None), limits, known, *RANGE_COLUMNS, *STEP_COLUMNS, "coded")
    coded = F.coalesce("_coded", F.lit(False))
    tested = _step_tested(_range_tested(rows))
    results = {c: F.when(~coded, F.col(c)) for c in (*RANGE_RESULT, *STEP_RESULT)}
    own = {
        "quality_flag": F.when(coded, F.col("quality_flag") if "quality_flag" in batch.columns else F.lit(None)).otherwise(ingest_flag()),
        "code": F.when(coded, F.col("code") if "code" in batch.columns else F.lit(None).cast("string")),
        "measured": F.when(coded, F.lit(MISSING)).otherwise(F.col("measured")),
    }
    return tested.withColumns({**own, **results}).select(*dict.fromkeys([*batch.columns, *own, *results]))


def qc_final(
    obs: DataFrame, range_thr: DataFrame, step_thr: DataFrame, persist_thr: DataFrame, station: DataFrame, variable: DataFrame
) -> DataFrame:
    """All three tests over stored readings, and the flag that counts."""
    tested = qc_tests(obs, station_limits(station, range=range_thr, step=step_thr), variable)
    judged = qc_persist_suspicious(qc_persist_test(tested, persist_limits(obs, persist_thr, station, variable)))
    return judged.withColumn("quality_flag", final_flag())


def rejudge(
    obs: DataFrame,
    touched: DataFrame,
    range_thr: DataFrame,
    step_thr: DataFrame,
    station: DataFrame,
    variable: DataFrame,
    limits: DataFrame | None = None,
) -> DataFrame:
    """Merged readings with the ingest flag of the touched keys, and of the readings that follow one, judged anew.

    ``obs`` reaches one interval around the touched keys. Coded readings and those without an interval stay as they are.
    """
    limits = station_limits(station, range=range_thr, step=step_thr) if limits is None else limits
    known = variable.withColumn("coded", is_coded())
    marked = obs.join(touched.select(*KEY).distinct().withColumn("_new", F.lit(True)), KEY, "left").withColumn(
        "_month", F.month("datetime")
    )
    stepped = with_previous(marked, [*SERIES, "seconds", "_month"], ["measured", "_new"])
    changes = stepped.select(
        *obs.columns,
        F.coalesce("_new", "prev__new", F.lit(False)).alias("_near"),
        (F.col("measured") - F.col("prev_measured")).alias("diff_value"),
        F.coalesce(seconds_between("datetime", "prev_datetime"), F.lit(0)).alias("diff_seconds"),
    )
    judged = _step_tested(_range_tested(_with_limits(changes, limits, known, *RANGE_COLUMNS, *STEP_COLUMNS, "coded")))
    due = F.col("seconds").isNotNull() & ~F.coalesce("_coded", F.lit(False)) & F.col("_near")
    return judged.withColumn("quality_flag", F.when(due, ingest_flag()).otherwise(F.col("quality_flag"))).select(*obs.columns)


def modal_interval(obs: DataFrame) -> DataFrame:
    """Most frequent gap in seconds; the first row counts as gap 0, the smaller gap wins a tie."""
    gaps = with_previous(obs.select(*SERIES, "datetime"), SERIES, []).select(
        *SERIES, F.coalesce(seconds_between("datetime", "prev_datetime"), F.lit(0)).alias("gap")
    )
    counts = gaps.groupBy(*SERIES, "gap").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*SERIES).agg(
        F.abs(F.max_by("gap", F.struct("n", -F.col("gap")))).cast("int").alias("interval")
    )


def persist_window(keys: DataFrame, station: DataFrame, variable: DataFrame) -> DataFrame:
    """Length in seconds of the range in which a series must vary."""
    s = station.select(F.col("id").alias("station_id"), "is_automatic")
    v = _variable_part(variable, "persistence_window", "persistence_window_hourly")
    hours = F.when(F.col("is_automatic"), F.coalesce("_persistence_window_hourly", F.lit(1))).otherwise(
        F.coalesce("_persistence_window", F.lit(96))
    )
    return (
        keys.join(s, "station_id", "left")
        .join(v, "variable_id", "left")
        .select(
            *keys.columns,
            # a pair missing from a dimension gets one hour
            F.when(F.col("is_automatic").isNull(), F.lit(3600)).otherwise(hours * 3600).alias("window"),
        )
    )


def persist_limits(obs: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame) -> DataFrame:
    """Per series: modal interval, window and the limit found for them."""
    keys = persist_window(modal_interval(obs), station, variable)
    return resolve_persist_threshold(keys, thr, station, variable)


def qc_persist_test(obs: DataFrame, limits: DataFrame) -> DataFrame:
    """Spread of the measurements over the closed range [t - window, t] against the limit.

    A maximum of the value and one of its negative give the spread in the same two passes.
    """
    rows = lookup(obs, limits, SERIES)
    spread = sliding_max(
        rows,
        SERIES,
        F.coalesce(F.col("window"), F.lit(1)),
        {"_hi": F.col("measured"), "_neg_lo": -F.col("measured")},
    ).withColumn("persist_value", F.col("_hi") + F.col("_neg_lo"))
    no_limit = F.col("persist_min").isNull()
    return (
        spread.withColumn(
            "qc_persist_quality_flag",
            F.when(no_limit, NOT_CHECKED).when(F.col("persist_value") >= F.col("persist_min"), GOOD).otherwise(BAD),
        )
        .withColumn("qc_persist_description", F.when(no_limit, NOT_FOUND).otherwise(F.col("persist_description")))
        .select(*obs.columns, "window", "persist_value", "qc_persist_quality_flag", "qc_persist_description")
    )


def qc_persist_suspicious(tested: DataFrame) -> DataFrame:
    """A reading is suspicious when the window that follows it holds a reading bad by persistence.

    Uses the flags just computed; ``updated`` tells which rows changed because of that.
    """
    flag = F.col("qc_persist_quality_flag")
    ahead = sliding_max(
        tested, SERIES, F.coalesce(F.col("window"), F.lit(1)), {"_bad": (flag == BAD).cast("int")}, ahead=True
    )
    hit = ~flag.isin(BAD, SUSPICIOUS) & (F.col("_bad") == 1)
    return (
        ahead.withColumn("updated", hit)
        .withColumn("qc_persist_quality_flag", F.when(hit, SUSPICIOUS).otherwise(flag))
        .drop("_bad")
    )


def touched_ranges(batch: DataFrame) -> DataFrame:
    """First and last touched time of each series and day."""
    return batch.groupBy(*SERIES, F.to_date("datetime").alias("_day")).agg(
        F.min("datetime").alias("start_datetime"), F.max("datetime").alias("end_datetime")
    ).drop("_day")


def around_ranges(obs: DataFrame, ranges: DataFrame, limits: DataFrame) -> DataFrame:
    """Readings two windows around the touched ranges; ``_due`` marks those within one window, whose flags may change.

    A touched value changes the spread of the window behind it, and a bad reading marks the window before it. So the
    flags of one window around a range depend on values of two. Ranges meet readings by day; a day knows the few ranges near it.
    """
    wide = lookup(ranges, limits.select(*SERIES, "window"), SERIES, how="inner", spread="start_datetime")
    w = F.greatest(F.coalesce("window", F.lit(1)), F.lit(1)).cast("long")
    near = wide.select(
        *SERIES,
        F.struct(
            shift_seconds("start_datetime", -2 * w).alias("first"),
            shift_seconds("start_datetime", -w).alias("due_first"),
            shift_seconds("end_datetime", w).alias("due_last"),
            shift_seconds("end_datetime", 2 * w).alias("last"),
        ).alias("r"),
    )
    days = near.withColumn("_day", F.explode(F.sequence(F.to_date("r.first"), F.to_date("r.last"))))
    by_day = days.groupBy(*SERIES, "_day").agg(F.collect_list("r").alias("_near"))
    rows = lookup(obs.withColumn("_day", F.to_date("datetime")), by_day, [*SERIES, "_day"], how="inner")
    at = F.col("datetime")
    return (
        rows.filter(F.exists("_near", lambda r: at.between(r["first"], r["last"])))
        .withColumn("_due", F.exists("_near", lambda r: at.between(r["due_first"], r["due_last"])))
        .select(*obs.columns, "_due")
    )


PERSIST_RESULT = ["qc_persist_quality_flag", "qc_persist_description"]


def qc_persist_refresh(obs: DataFrame, touched: DataFrame, limits: DataFrame) -> DataFrame:
    """Readings whose persistence or final flag changes because of the touched keys, with the new flags.

    ``obs`` are the stored readings after the touched ones were merged, with the flags of all three tests; ``limits`` are those of ``persist_limits``.
    Flags depend on values only, so one pass settles them: a second one finds nothing to change.
    """
    near = around_ranges(obs, touched_ranges(touched), limits)
    before = {c: f"_old_{c}" for c in (*PERSIST_RESULT, "quality_flag")}
    judged = qc_persist_suspicious(qc_persist_test(near.withColumnsRenamed(before), limits))
    judged = judged.withColumn("quality_flag", final_flag())
    changed = ~F.col("qc_persist_quality_flag").eqNullSafe(F.col("_old_qc_persist_quality_flag")) | ~F.col("quality_flag").eqNullSafe(
        F.col("_old_quality_flag")
    )
    return judged.filter(F.col("_due") & changed).select(*obs.columns)


# lists ----------------------------------------------------------------------------------------


def threshold_matrix(
    pairs: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame, interval: int
) -> DataFrame:
    """Twelve months of global, reference and own limits as text; ``---`` where there is none and
    ``*`` where the reference holds for any interval."""
    auto = F.col("is_automatic")

    def overall(limit: str) -> Column:
        return F.when(auto, F.col(f"_{limit}_hourly")).otherwise(F.col(f"_{limit}"))

    dims = _variable_part(variable, "range_min", "range_max", "range_min_hourly", "range_max_hourly")
    months = pairs.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    return _limits_as_text(
        months.join(dims, "variable_id", "left"),
        months.columns,
        thr,
        station,
        interval,
        ["month"],
        {"min": ("range_min", overall("range_min")), "max": ("range_max", overall("range_max"))},
    )


def step_threshold_matrix(
    pairs: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame, interval: int
) -> DataFrame:
    auto = F.col("is_automatic")
    size = F.when(auto, F.col("_step_hourly")).otherwise(F.col("_step"))
    dims = _variable_part(variable, "step", "step_hourly")
    rows = pairs.join(dims, "variable_id", "left")
    return _limits_as_text(
        rows, pairs.columns, thr, station, interval, [], {"min": ("step_min", -size), "max": ("step_max", size)}
    )


def persist_threshold_matrix(
    pairs: DataFrame, thr: DataFrame, station: DataFrame, variable: DataFrame, interval: int
) -> DataFrame:
    """Smallest variation and window; thresholds are looked up for the window each pair uses."""
    auto = F.col("is_automatic")
    dims = _variable_part(variable, "persistence", "persistence_hourly")
    rows = persist_window(pairs, station, variable).join(dims, "variable_id", "left")
    size = F.when(auto, F.col("_persistence_hourly")).otherwise(F.col("_persistence"))
    return _limits_as_text(
        rows,
        pairs.columns,
        thr,
        station,
        interval,
        ["window"],
        {"var": ("minimum_variance", size), "win": ("window", F.col("window"))},
    )


def _limits_as_text(
    rows: DataFrame,
    columns: list[str],
    thr: DataFrame,
    station: DataFrame,
    interval: int,
    detail: list[str],
    limits: dict[str, tuple[str, Column]],
) -> DataFrame:
    """``limits`` gives for each label the threshold column and the global value."""
    rows = rows.withColumn("interval", F.lit(interval)).join(_station_part(station), "station_id", "left")
    names = [limit for limit, _ in limits.values()]
    shown = thr.withColumns({f"_t_{n}": F.col(n) for n in names})
    for owner, exact, name in STEPS:
        if name != "_own_any":  # not shown
            rows = _attempt(rows, shown, owner, exact, detail, [f"_t_{n}" for n in names], name)
    none = F.lit("---")
    out = [F.col(c) for c in columns]
    for label, (limit, overall) in limits.items():
        starred = F.concat(F.col(f"_ref_any._t_{limit}").cast("string"), F.lit("*"))
        reference = F.when(
            F.col("_ref_exact").isNotNull(), F.col(f"_ref_exact._t_{limit}").cast("string")
        ).otherwise(starred)
        out += [
            F.coalesce(overall.cast("string"), none).alias(f"global_{label}"),
            F.coalesce(reference, none).alias(f"reference_{label}"),
            F.coalesce(F.col(f"_own_exact._t_{limit}").cast("string"), none).alias(f"custom_{label}"),
        ]
    return rows.select(*out)


def range_threshold_list(
    thr: DataFrame, variable: DataFrame, variable_ids: list[int] | None = None, month: int | None = None
) -> DataFrame:
    rows = thr
    if variable_ids is not None:
        rows = rows.filter(F.col("variable_id").isin(variable_ids))
    if month is not None:
        rows = rows.filter(F.col("month") == month)
    names = variable.select(F.col("id").alias("variable_id"), "symbol", F.col("name").alias("variable_name"))
    return (
        rows.join(names, "variable_id")
        .withColumn("month_name", F.date_format(F.make_date(F.lit(2000), "month", F.lit(1)), "MMMM"))
        .orderBy("variable_name", "month", "station_id")
    )


def qc_review_list(obs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = obs
    if start is not None:
        rows = rows.filter(F.col("datetime") >= ts(start))
    if end is not None:
        rows = rows.filter(F.col("datetime") <= ts(end))
    return rows.select(
        *KEY,
        "measured",
        "consisted",
        F.col("quality_flag").alias("automatic_flag"),
        "manual_flag",
        "remarks",
        "ml_flag",
    ).orderBy(*KEY)
