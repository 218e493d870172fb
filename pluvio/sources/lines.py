"""Text files as lines, and the pieces logger formats share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvio.functions.joins import lookup

# a comma outside quotes; only used on lines that have a comma inside quotes
QUOTED_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
# fields without a comma inside quotes
PLAIN_FIELDS = '^(?:[^",]*+|"[^",]*+")(?:,(?:[^",]*+|"[^",]*+"))*+$'


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """``(path, line)`` of all files under ``path``; large files are split between tasks."""
    return (
        spark.read.option("encoding", encoding)
        .option("recursiveFileLookup", True)
        .text(path)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    )


def clean_line(line: Column) -> Column:
    """Without NUL bytes and trailing blanks."""
    return F.rtrim(F.replace(line, F.lit("\0"), F.lit("")))


def csv_fields(line: Column) -> Column:
    """Fields of a CSV line, still quoted."""
    return F.when(line.rlike(PLAIN_FIELDS), F.split(line, ",", -1)).otherwise(F.split(line, QUOTED_COMMA, -1))


def unquoted(field: Column) -> Column:
    return F.btrim(F.trim(field), F.lit('"'))


def first_field(line: Column, separator: str = ",") -> Column:
    return unquoted(F.substring_index(line, separator, 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def station_offsets(station: DataFrame) -> DataFrame:
    return station.select(F.col("code").alias("station_code"), F.col("id").alias("station_id"), "utc_offset_minutes")


def mapped_cells(
    data: DataFrame, header: DataFrame, var_format: DataFrame, fields: Column, ignored: list[str] | None = None
) -> DataFrame:
    """One row per non-empty cell whose column name has a look-up key.

    ``header`` has one ``(path, names, ...)`` row per file; ``fields`` splits a data line. Names are mapped once per file, to what
    each position of its lines stands for; so only cells that are wanted ever become rows.
    """
    extra = [c for c in header.columns if c not in ("path", "names")]
    keep = [c for c in (*data.columns, *extra) if c not in ("path", "line")]
    named = header.select("path", F.posexplode("names").alias("_pos", "_name")).select(
        "path", "_pos", unquoted(F.col("_name")).alias("lookup_key")
    )
    if ignored:
        named = named.filter(~F.col("lookup_key").isin(ignored))
    known = named.join(var_format.select("lookup_key", "variable_id", "seconds"), "lookup_key").distinct()
    meant = known.groupBy("path", "_pos").agg(F.collect_list(F.struct("variable_id", "seconds")).alias("_to"))
    by_file = meant.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("_pos", "_to"))).alias("_map"))
    none = F.array().cast(meant.schema["_to"].dataType)
    slots = F.transform("names", lambda name, pos: F.coalesce(F.try_element_at("_map", pos), none))
    layout = header.join(by_file, "path").select("path", *extra, slots.alias("_slots"))

    def cell(to: Column, text: Column) -> Column:
        filled = F.transform(to, lambda t: F.struct(t["variable_id"], t["seconds"], text.alias("text")))
        return F.coalesce(F.filter(filled, lambda c: c["text"].isNotNull() & (c["text"] != "") & (c["text"] != "NAN")), F.array().cast(kind))

    whole = meant.schema["_to"].dataType.elementType.fields
    kind = T.ArrayType(T.StructType([T.StructField(f.name, f.dataType) for f in whole] + [T.StructField("text", T.StringType())]))
    lines = lookup(data, layout, ["path"], "inner", spread="line")
    cells = F.flatten(F.zip_with("_slots", F.transform(fields, unquoted), cell))
    return lines.select("path", *keep, F.inline(cells).alias("variable_id", "seconds", "text"))
