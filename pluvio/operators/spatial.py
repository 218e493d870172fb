"""Areas around points, raster look-up, gridded analysis, contour levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.joins import lookup

NOT_FOUND = "NOT FOUND"
OUTSIDE = -999


# Room left for rounding where an edge is cut to a band of cells, as a share of a cell.
MARGIN = 1e-9


def _crossings(edges: Column, x: Column, y: Column) -> Column:
    """How many edges a ray from the point towards growing x crosses."""

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        at = F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        return spans & (x < at)

    return F.size(F.filter(edges, crosses))


def _edge_bands(polygons: DataFrame, cell: float) -> DataFrame:
    """(poly, name, edge, cy, low, high): each edge once for every row of cells it reaches, with the columns it covers there."""
    ids = polygons.select("name", "rings", F.xxhash64("rings").alias("poly")).dropDuplicates(["name", "poly"])
    rings = ids.select("name", "poly", F.explode("rings").alias("ring"))
    pairs = F.transform(
        F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(0))),
        lambda b, i: F.struct(
            F.get("ring", i)["x"].alias("ax"), F.get("ring", i)["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")
        ),
    )
    ay, by, ax, bx = (F.col(f"edge.{c}") for c in ("ay", "by", "ax", "bx"))
    # a level edge is never crossed
    edges = rings.select("name", "poly", F.explode(pairs).alias("edge")).filter(ay != by)
    bottom, top = F.least(ay, by), F.greatest(ay, by)

    def row(y: Column) -> Column:
        return F.floor(y / cell).cast("int")

    banded = edges.withColumn("cy", F.explode(F.sequence(row(bottom), row(top))))

    def x_at(y: Column) -> Column:
        inside = F.least(F.greatest(y, bottom), top)
        return (bx - ax) * ((inside - ay) / (by - ay)) + ax

    ends = [x_at((F.col("cy") - MARGIN) * cell), x_at((F.col("cy") + 1 + MARGIN) * cell)]
    return banded.withColumns(
        {
            "low": F.floor(F.least(*ends) / cell - MARGIN).cast("int"),
            "high": F.floor(F.greatest(*ends) / cell + MARGIN).cast("int"),
        }
    )


def polygon_cells(polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """For each grid cell the polygons that reach it, each with the edges inside the cell and what the rest adds.

    Edges right of a cell are all crossed by a ray from within it where they span the ray's height, so only
    their ends matter: an end counts one for every edge that has it, and two edges that meet right of the cell cancel out.
    ``breaks`` keeps the heights left over, at most two for each edge that leaves the cell; a point is inside if its
    crossings and the breaks above it are odd together. A cell within a polygon keeps one break above all points
    and no edge. Rings are closed (first point = last point) and are never copied as a whole.
    """
    bands = _edge_bands(polygons, cell)
    own = bands.select(
        "name", "poly", "cy", F.explode(F.sequence("low", "high")).alias("cx"), "edge", F.lit(None).cast("double").alias("above")
    )
    row = F.floor(F.col("y") / cell)
    # ends below the band are under all its points, those over it above all of them
    ends = (
        bands.select("name", "poly", "cy", "low", F.explode(F.array("edge.ay", "edge.by")).alias("y"))
        .filter(row >= F.col("cy"))
        .groupBy("name", "poly", "cy", F.when(row > F.col("cy"), F.lit(float("inf"))).otherwise(F.col("y")).alias("above"), "low")
        .agg((F.count(F.lit(1)) % 2).alias("odd"))
        .filter("odd = 1")
        .groupBy("name", "poly", "cy", "above")
        .agg(F.sort_array(F.collect_list("low")).alias("lows"))
    )
    # a cell sees an end where an odd number of its edges start right of the cell: between each two of their columns
    runs = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("lows") / 2).cast("int")),
        lambda k: F.sequence(F.element_at("lows", 2 * k - 1), F.element_at("lows", 2 * k) - 1),
    )
    carried = ends.filter(F.size("lows") > 1).select(
        "name", "poly", "cy", F.explode(F.flatten(runs)).alias("cx"), F.lit(None).cast(bands.schema["edge"].dataType).alias("edge"), "above"
    )
    return (
        own.unionByName(carried)
        .groupBy("cx", "cy", "name", "poly")
        .agg(F.collect_list("edge").alias("edges"), F.collect_list("above").alias("breaks"))
        .groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
        .agg(F.collect_list(F.struct("name", "edges", "breaks")).alias("_candidates"))
    )


def point_in_polygon(
    points: DataFrame, polygons: DataFrame, out: str, cell: float = 1.0, lon: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    """Name of the polygon holding each point by the even-odd rule, the first by name of several, else ``NOT FOUND``.

    A point meets one row, that of its cell, and tests its candidates in place: no pairs are
    produced and nothing is grouped afterwards.
    """
    x, y = F.col(lon), F.col(lat)
    celled = points.withColumns({"_cx": F.floor(x / cell).cast("int"), "_cy": F.floor(y / cell).cast("int")})
    located = lookup(celled, polygon_cells(polygons, cell), ["_cx", "_cy"], spread=[lon, lat])

    def holds(p: Column) -> Column:
        return (_crossings(p["edges"], x, y) + F.size(F.filter(p["breaks"], lambda b: b > y))) % 2 == 1

    names = F.transform(F.filter("_candidates", holds), lambda p: p["name"])
    return located.withColumn(out, F.coalesce(F.array_min(names), F.lit(NOT_FOUND))).select(*points.columns, out)


def grid_altitude_lookup(
    points: DataFrame,
    cells: DataFrame,
    west: float,
    north: float,
    size: float,
    lon: str = "longitude",
    lat: str = "latitude",
) -> DataFrame:
    """Elevation of the raster cell under each point; ``cells`` holds (row, col, elevation)."""
    return (
        points.withColumns(
            {
                "row": F.floor((F.lit(north) - F.col(lat)) / F.lit(size)).cast("int"),
                "col": F.floor((F.col(lon) - F.lit(west)) / F.lit(size)).cast("int"),
            }
        )
        .join(cells.select("row", "col", "elevation"), ["row", "col"], "left")
        .select(*points.columns, F.coalesce("elevation", F.lit(OUTSIDE)).alias("elevation"))
    )


def clean_points(points: DataFrame, by: Sequence[str], order: str = "station_id") -> DataFrame:
    """Drops points without a value and keeps the first of those sharing coordinates."""
    rest = [c for c in points.columns if c not in (*by, "longitude", "latitude", order)]
    return (
        points.filter(~F.isnan("value") & F.col("value").isNotNull())
        .groupBy(*by, "longitude", "latitude")
        .agg(F.min(F.struct(order, *rest)).alias("_p"))
        .select(*by, "longitude", "latitude", "_p.*")
    )


def cressman_grid(
    points: DataFrame,
    by: Sequence[str],
    west: float,
    south: float,
    east: float,
    north: float,
    hres: float = 0.01,
    radius: float = 0.7,
    minimum_neighbors: int = 1,
) -> DataFrame:
    """Weighted mean of the points within ``radius`` of each grid node, for every slice in ``by``.

    Each point is spread over the nodes it reaches (bounded by radius and resolution, whatever the
    number of points) and partial sums per node are formed before the shuffle, so a slice with many
    points does not gather in one task. Nodes with too few neighbours are left out; ``dense_grid``
    adds them as nulls.
    """
    nx, ny = _steps(west, east, hres), _steps(south, north, hres)
    dx, dy = (east - west) / (nx - 1), (north - south) / (ny - 1)

    def reach(center: Column, start: float, step: float, count: int) -> Column:
        low = F.greatest(F.ceil((center - radius - start) / step).cast("int"), F.lit(0))
        high = F.least(F.floor((center + radius - start) / step).cast("int"), F.lit(count - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    reached = points.select(
        *by, "longitude", "latitude", "value", F.explode(reach(F.col("longitude"), west, dx, nx)).alias("gx")
    ).select("*", F.explode(reach(F.col("latitude"), south, dy, ny)).alias("gy"))
    ox = F.lit(west) + F.col("gx") * F.lit(dx) - F.col("longitude")
    oy = F.lit(south) + F.col("gy") * F.lit(dy) - F.col("latitude")
    r2 = F.lit(radius * radius)
    weighted = (
        reached.withColumn("_d2", ox * ox + oy * oy)
        .filter(F.col("_d2") <= r2)
        .withColumn("_w", (r2 - F.col("_d2")) / (r2 + F.col("_d2")))
    )
    return (
        weighted.groupBy(*by, "gx", "gy")
        .agg(
            F.sum(F.col("_w") * F.col("value")).alias("_wv"),
            F.sum("_w").alias("_ws"),
            F.count(F.lit(1)).alias("neighbors"),
        )
        .filter(F.col("neighbors") >= minimum_neighbors)
        .select(
            *by,
            "gx",
            "gy",
            (F.lit(west) + F.col("gx") * F.lit(dx)).alias("longitude"),
            (F.lit(south) + F.col("gy") * F.lit(dy)).alias("latitude"),
            F.try_divide("_wv", "_ws").alias("value"),
            "neighbors",
        )
    )


def _steps(low: float, high: float, hres: float) -> int:
    # the quotient is settled before rounding up, so 3 / 0.01 gives 300 nodes and not 301
    return max(int(math.ceil(round((high - low) / hres, 9))), 2)


def dense_grid(
    grid: DataFrame, by: Sequence[str], west: float, south: float, east: float, north: float, hres: float
) -> DataFrame:
    """Every node of every slice, null where the analysis has no value."""
    nx, ny = _steps(west, east, hres), _steps(south, north, hres)
    nodes = (
        grid.select(*by)
        .distinct()
        .withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
        .withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    )
    return nodes.join(grid.select(*by, "gx", "gy", "value"), [*by, "gx", "gy"], "left")


def contour_levels(grid: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whole-number levels from below the minimum up to the maximum of each slice."""
    low, high = F.col("_min").cast("int") - 1, F.col("_max").cast("int") + 1
    same = low == high
    return (
        grid.groupBy(*by)
        .agg(F.min("value").alias("_min"), F.max("value").alias("_max"))
        .select(
            *by,
            F.sequence(F.when(same, low - 5).otherwise(low), F.when(same, high + 4).otherwise(high - 1)).alias("levels"),
        )
    )
