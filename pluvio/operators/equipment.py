"""Equipment places and history, maintenance visits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.series import with_previous

OFFICE = "Office"


def _last_visit(visit_equipment: DataFrame, visits: DataFrame, side: str) -> DataFrame:
    """Newest visit that names an equipment on one side (new = installed, old = taken out)."""
    v = visits.select(F.col("id").alias("visit_id"), "visit_date", "station_id", "status")
    rows = visit_equipment.filter(F.col(f"{side}_equipment_id").isNotNull()).select(
        F.col(f"{side}_equipment_id").alias("equipment_id"), "visit_id"
    )
    newest = F.max(F.struct("visit_date", "visit_id", "station_id", "status"))
    return rows.join(v, "visit_id").groupBy("equipment_id").agg(newest.alias(f"_{side}"))


def equipment_status(visit_equipment: DataFrame, visits: DataFrame) -> DataFrame:
    """Last installation and last removal of each equipment, whether it is installed and where."""
    both = _last_visit(visit_equipment, visits, "new").join(
        _last_visit(visit_equipment, visits, "old"), "equipment_id", "full_outer"
    )
    installed = F.col("_new").isNotNull() & (
        F.col("_old").isNull() | (F.col("_new.visit_date") >= F.col("_old.visit_date"))
    )
    return both.withColumn("installed", installed).withColumn(
        "location_id", F.when(F.col("installed"), F.col("_new.station_id"))
    )


def equipment_location(visit_equipment: DataFrame, visits: DataFrame, station: DataFrame) -> DataFrame:
    """Station where an equipment stands, else the office."""
    places = station.select(F.col("id").alias("location_id"), F.concat("name", F.lit(" - "), "code").alias("_place"))
    return (
        equipment_status(visit_equipment, visits)
        .join(places, "location_id", "left")
        .select("equipment_id", "location_id", F.coalesce("_place", F.lit(OFFICE)).alias("location"))
    )


def equipment_available(equipment: DataFrame, visit_equipment: DataFrame, visits: DataFrame) -> DataFrame:
    """Equipment that may be chosen for a visit, with the only station it may go to, if restricted.

    Installed equipment is out; one whose removal is not approved yet is kept for the removing station.
    """
    status = equipment_status(visit_equipment, visits)
    held = F.col("_old").isNotNull() & (F.col("_old.status") != "A")
    return (
        equipment.select(F.col("id").alias("equipment_id"))
        .join(status, "equipment_id", "left")
        .filter(~F.coalesce("installed", F.lit(False)))
        .select("equipment_id", F.when(held, F.col("_old.station_id")).alias("only_station_id"))
    )


def available_to(available: DataFrame, station_id: int) -> DataFrame:
    return available.filter(F.col("only_station_id").isNull() | (F.col("only_station_id") == station_id))


def class_text(code: Column) -> Column:
    return (
        F.when(code == "F", "Fully Functional").when(code == "P", "Partially Functional").when(code == "N", "Not Functional")
    )


def equipment_inventory(
    equipment: DataFrame,
    equipment_type: DataFrame,
    manufacturer: DataFrame,
    funding_source: DataFrame,
    locations: DataFrame,
) -> DataFrame:
    """Equipment with its names and place; rows whose type, maker or funding does not exist are dropped."""

    def named(df: DataFrame, key: str, out: str) -> DataFrame:
        return df.select(F.col("id").alias(key), F.col("name").alias(out))

    return (
        equipment.withColumnRenamed("id", "equipment_id")
        .join(named(equipment_type, "equipment_type_id", "equipment_type"), "equipment_type_id")
        .join(named(manufacturer, "manufacturer_id", "manufacturer"), "manufacturer_id")
        .join(named(funding_source, "funding_source_id", "funding_source"), "funding_source_id")
        .join(locations, "equipment_id", "left")
        .select(
            "equipment_id",
            "equipment_type",
            "manufacturer",
            "funding_source",
            "model",
            "serial_number",
            F.coalesce("location", F.lit(OFFICE)).alias("location"),
            "location_id",
            class_text(F.col("classification")).alias("classification"),
            "equipment_type_id",
        )
        .orderBy("equipment_type_id", "serial_number")
    )


def maintenance_list(
    visits: DataFrame,
    station: DataFrame,
    profile: DataFrame,
    technician: DataFrame,
    visit_type: DataFrame,
    first: dt.date,
    last: dt.date,
    is_automatic: bool,
) -> DataFrame:
    s = station.select(
        F.col("id").alias("station_id"), F.col("name").alias("station_name"), "is_automatic", "profile_id"
    ).filter(F.col("is_automatic") == is_automatic)
    status = F.col("status")
    return (
        visits.filter((F.col("visit_date") >= F.lit(first)) & (F.col("visit_date") <= F.lit(last)) & (status != "-"))
        .join(s, "station_id")
        .join(profile.select(F.col("id").alias("profile_id"), F.col("name").alias("station_profile")), "profile_id")
        .join(technician.select(F.col("id").alias("technician_id"), F.col("name").alias("technician")), "technician_id")
        .join(visit_type.select(F.col("id").alias("visit_type_id"), F.col("name").alias("type_of_visit")), "visit_type_id")
        .select(
            F.col("id").alias("visit_id"),
            "station_name",
            "station_profile",
            F.when(F.col("is_automatic"), "Automatic").otherwise("Manual").alias("station_type"),
            "visit_date",
            "technician",
            "type_of_visit",
            F.when(status == "A", "Approved").when(status == "P", "Published").otherwise("Draft").alias("status"),
        )
    )


def equipment_change(old: str = "old_equipment_id", new: str = "new_equipment_id") -> Column:
    o, n = F.col(old), F.col(new)
    return F.when(o.isNull(), "Add").when(n.isNull(), "Remove").when(o != n, "Change").otherwise("Update")


def equipment_transitions(visit_equipment: DataFrame) -> DataFrame:
    return visit_equipment.withColumn("change", equipment_change())


def previous_visit_equipment(visits: DataFrame, visit_equipment: DataFrame) -> DataFrame:
    """Equipment standing after a station's last earlier visit, as the opening rows of each visit.

    Old and new equipment are the same in a carried row; ``change`` is the class of the source row.
    """
    dated = visits.select(
        "station_id", F.col("id").alias("visit_id"), F.col("visit_date").cast("timestamp").alias("datetime")
    )
    before = with_previous(dated, ["station_id"], ["visit_id"], block_seconds=3650 * 86400).filter(
        "prev_visit_id IS NOT NULL"
    )
    rows = equipment_transitions(visit_equipment).filter("new_equipment_id IS NOT NULL")
    return (
        before.select("station_id", "visit_id", "prev_visit_id")
        .join(rows.withColumnRenamed("visit_id", "prev_visit_id"), "prev_visit_id")
        .select(
            "visit_id",
            "station_id",
            F.col("prev_visit_id").alias("previous_visit_id"),
            "equipment_order",
            F.col("new_equipment_id").alias("old_equipment_id"),
            "new_equipment_id",
            "change",
        )
    )


def first_contacts(visits: DataFrame) -> DataFrame:
    """Contacts of the earliest visit that names any."""
    return (
        visits.filter(F.col("contacts").isNotNull() & (F.col("contacts") != ""))
        .groupBy("station_id")
        .agg(F.min_by("contacts", "visit_date").alias("contacts"))
    )


def equipment_change_history(history: DataFrame, fields: list[str], key: str = "equipment_id") -> DataFrame:
    """Changed fields between consecutive versions of a record, old and new value as text.

    A value that appears or goes (null on one side) is a change; the first version of a record has none.
    """
    stepped = with_previous(history, [key], fields, block_seconds=3650 * 86400).filter("prev_datetime IS NOT NULL")
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"prev_{f}").cast("string").alias("old_value"),
                F.col(f).cast("string").alias("new_value"),
                (~F.col(f).eqNullSafe(F.col(f"prev_{f}"))).alias("_changed"),
            )
            for f in fields
        ]
    )
    return stepped.select(key, "datetime", F.inline(F.filter(cells, lambda c: c["_changed"]))).drop("_changed")
