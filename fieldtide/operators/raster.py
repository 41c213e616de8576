"""Label rasters as cell tables: sampling, restoring, decoding, lookup."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtide.functions import geo

def raster_cells(
    cells: DataFrame, origin_x: float, origin_y: float, size: float,
) -> DataFrame:
    """Cells with the lon and lat of their centre (projected grid in Albers metres)."""
    x, y = geo.cell_centre(F.col("row"), F.col("col"), origin_x, origin_y, size)
    lon, lat = geo.albers_to_lonlat(x, y)
    return cells.select("*", x.alias("x"), y.alias("y"), lon.alias("lon"), lat.alias("lat"))


def grid_sample(
    cells: DataFrame, interval: int, start: int | None = None, seed: int = 42,
) -> DataFrame:
    """Every interval-th row and column from one start that both axes share.

    Without a start the seed draws one, the same in every run.
    """
    s = random.Random(seed).randrange(interval) if start is None else start
    on = lambda c: (F.col(c) >= s) & (F.pmod(F.col(c) - s, F.lit(interval)) == 0)
    return cells.where(on("row") & on("col"))


def grid_restore(
    samples: DataFrame, rows: int, cols: int, interval: int, start: int | None = None,
) -> DataFrame:
    """Samples back on a zero grid at start + i * interval; positions outside are dropped.

    samples carries the dense sample position (i, j). The default start is half
    the interval.
    """
    s = interval // 2 if start is None else start
    grid = samples.sparkSession.range(rows * cols).select(
        F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    placed = samples.select(
        (F.col("i") * interval + s).alias("row"), (F.col("j") * interval + s).alias("col"), "code")
    return grid.join(placed, ["row", "col"], "left").withColumn(
        "code", F.coalesce("code", F.lit(0)))


def unique_legend(legend: DataFrame) -> DataFrame:
    """Legend rows with a name, one per code of any size; a code with two rows is an error."""
    columns = ["Class_Names", "ESRI_Red", "ESRI_Green", "ESRI_Blue"]
    once = legend.where(F.col("Codes").isNotNull() & F.col("Class_Names").isNotNull()).groupBy(
        "Codes").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*columns)).alias("_row"))
    checked = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(
        F.concat(F.lit("legend code with several rows: "), F.col("Codes").cast("string"))))
    return once.select("Codes", checked.alias("_row")).select("Codes", "_row.*")


def decode_classes(cells: DataFrame, legend: DataFrame) -> DataFrame:
    """Class name and colour of each cell; unmapped codes get no name and black.

    Adaptive execution broadcasts the legend when its measured size allows it.
    """
    dim = unique_legend(legend).select(
        F.col("Codes").alias("code"), F.col("Class_Names").alias("class_name"),
        F.col("ESRI_Red").alias("red"), F.col("ESRI_Green").alias("green"),
        F.col("ESRI_Blue").alias("blue"))
    black = [F.coalesce(c, F.lit(0)).alias(c) for c in ("red", "green", "blue")]
    joined = cells.join(dim, "code", "left")
    return joined.select(*[c for c in joined.columns if c not in ("red", "green", "blue")], *black)


def counted_points(points: DataFrame) -> DataFrame:
    """Distinct points with `points`, how often each occurs: equal ones are sampled once."""
    return points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("points"))


def sample_at_points(
    points: DataFrame, cells: DataFrame, x: Column, y: Column,
    origin_x: float, origin_y: float, size: float, rasters: Sequence[str] = (),
) -> DataFrame:
    """Value of the cell under each point; null where the raster has no cell.

    `rasters` names columns of both tables that tell rasters apart, so one join samples all of
    them; a raster that could not be read has no cells and gives nulls. The point is turned into
    its cell index, so the lookup is an equi-join. The columns row and col of the point are added.
    """
    row, col = geo.cell_index(x, y, origin_x, origin_y, size)
    placed = points.withColumn("row", row.cast("bigint")).withColumn("col", col.cast("bigint"))
    keys = [*rasters, "row", "col"]
    return placed.join(cells.select(*keys, "code"), keys, "left")


def sample_rasters(
    points: DataFrame, rasters: DataFrame, cells: DataFrame, on: Sequence[str],
) -> DataFrame:
    """Value of every raster at every point it is asked for, each in its own system and grid.

    points: lon and lat in degrees and the columns `on`, which tell the rasters a point is asked
    of (its tile, its scene). rasters: one row per raster and value of `on` with raster, epsg, origin_x, origin_y (upper left corner) and cell (its side, in units
    of the system). cells: raster, row, col, code. A point outside a raster, a raster that could
    not be read (it has no cells), a missing coordinate and a system that is neither degrees nor
    a UTM zone give a null code. The result has the point's columns, raster, row, col and code.

    Points meet the grid table first, so the cell lookup is one equi-join on (raster, row, col),
    dealt by all three. The grid table (a row per raster, no cells) is broadcast: dealt by `on`,
    all points of a tile would lie in one task. A point is projected once for all rasters that
    share a system.
    """
    grid = F.struct("raster", "origin_x", "origin_y", "cell")
    grids = rasters.groupBy(*on, "epsg").agg(F.collect_list(grid).alias("_grids"))
    asked = points.join(F.broadcast(grids), list(on))
    x, y = geo.lonlat_to_crs(F.col("lon"), F.col("lat"), F.col("epsg"))
    row = F.floor((F.col("origin_y") - F.col("_y")) / F.col("cell")).cast("bigint")
    col = F.floor((F.col("_x") - F.col("origin_x")) / F.col("cell")).cast("bigint")
    placed = asked.withColumns({"_x": x, "_y": y}).select(
        *points.columns, "_x", "_y", F.inline("_grids")).select(
        *points.columns, "raster", row.alias("row"), col.alias("col"))
    return placed.join(cells.select("raster", "row", "col", "code"), ["raster", "row", "col"], "left")


def crop_window(
    cells: DataFrame, size: int | None, top: int = 0, left: int = 0,
) -> DataFrame:
    """Square of the raster from (top, left); everything when size is None."""
    if size is None:
        return cells
    return cells.where(F.col("row").between(top, top + size - 1)
                       & F.col("col").between(left, left + size - 1))


def random_corner(rows: int, cols: int, size: int, seed: int) -> tuple[int, int]:
    """Seeded corner of a crop that lies inside the raster."""
    draw = lambda name: int(hashlib.md5(f"{seed}|{name}".encode()).hexdigest()[:8], 16)
    return draw("top") % max(1, rows - size + 1), draw("left") % max(1, cols - size + 1)


def value_histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("code").count()
