"""Transverse Mercator against published control points, and rasters in their own systems."""

import math

import pytest
from pyspark.sql import functions as F

from fieldtide.functions import geo
from fieldtide.operators import raster as rs


def _values(spark, *columns):
    return spark.range(1).select(*columns).first()


def _degrees(d, m, s):
    return d + m / 60 + s / 3600


def test_national_grid_example(spark):
    """Published worked example of the British national grid: Airy ellipsoid, 52 39 27.2531 N,
    1 43 4.5177 E is 651409.903 E, 313177.270 N."""
    airy = {"scale": 0.9996012717, "radius": 6377563.396, "flattening": 1 - 6356256.909 / 6377563.396}
    lit = F.lit
    x, y = geo.transverse_mercator(
        lit(_degrees(1, 43, 4.5177)), lit(_degrees(52, 39, 27.2531)), lit(-2.0), **airy)
    _, origin = geo.transverse_mercator(lit(-2.0), lit(49.0), lit(-2.0), **airy)
    east, north, start = _values(spark, x, y, origin)
    assert (east + 400_000, north - start - 100_000) == (pytest.approx(651409.903, abs=0.001), pytest.approx(313177.270, abs=0.001))


def test_textbook_example(spark):
    """Published example on the Clarke 1866 ellipsoid: 40 30 N, 73 30 W is 127106.5, 4484124.4."""
    x, y = geo.transverse_mercator(
        F.lit(-73.5), F.lit(40.5), F.lit(-75.0), radius=6378206.4, flattening=1 / 294.978698214)
    assert tuple(_values(spark, x, y)) == (pytest.approx(127106.5, abs=0.1), pytest.approx(4484124.4, abs=0.1))


@pytest.mark.parametrize("lon,lat,epsg", [
    (-90.6, 35.5, 32615), (-90.6, 35.5, 32616), (-93.0, 0.0, 32615), (151.2, -33.9, 32756), (9.0, 83.9, 32632),
    (3.0, 60.0, 32632), (-90.6, 35.5, 4326)])
def test_there_and_back(spark, lon, lat, epsg):
    x, y = geo.lonlat_to_crs(F.lit(lon), F.lit(lat), F.lit(epsg))
    back = geo.crs_to_lonlat(F.col("x"), F.col("y"), F.lit(epsg))
    there = spark.range(1).select(x.alias("x"), y.alias("y"))
    assert tuple(there.select(*back).first()) == (pytest.approx(lon, abs=1e-10), pytest.approx(lat, abs=1e-10))


def test_central_meridian_is_the_scaled_meridian_arc(spark):
    """At 45 degrees the WGS84 meridian arc is 4984944.378 m."""
    x, y = geo.lonlat_to_crs(F.lit(-93.0), F.lit(45.0), F.lit(32615))
    south = geo.lonlat_to_crs(F.lit(-93.0), F.lit(-45.0), F.lit(32715))[1]
    east, north, below = _values(spark, x, y, south)
    assert east == 500_000 and north == pytest.approx(0.9996 * 4984944.378, abs=0.001)
    assert below == pytest.approx(10_000_000 - north, abs=1e-6)


def test_points_in_rasters_of_their_own(spark):
    points = spark.createDataFrame(
        [("a", -90.6, 35.5), ("b", -90.6, 35.5), ("a", None, 35.5), ("c", 0.0, 0.0), ("d", 1.5, 2.5)],
        "tile string, lon double, lat double")
    grids, cells, want = [], [], {}
    for tile, epsg in (("a", 32615), ("b", 32616)):
        x, y = spark.range(1).select(*geo.lonlat_to_crs(F.lit(-90.6), F.lit(35.5), F.lit(epsg))).first()
        for k, cell in enumerate((10.0, 20.0, 60.0)):
            ox, oy = math.floor(x / cell) * cell - 3 * cell, math.floor(y / cell) * cell + 5 * cell
            grids.append((tile, f"{tile}{k}", epsg, ox, oy, cell))
            cells.append((f"{tile}{k}", 4, 3, 100 + k))
            want[f"{tile}{k}"] = 100 + k
    grids += [("a", "unread", 32615, 0.0, 0.0, 10.0), ("c", "strange", 3857, 0.0, 0.0, 1.0), ("d", "degrees", 4326, 1.0, 3.0, 0.25)]
    cells.append(("degrees", 2, 2, 7))
    rows = rs.sample_rasters(
        points, spark.createDataFrame(grids, "tile string, raster string, epsg int, origin_x double, origin_y double, cell double"),
        spark.createDataFrame(cells, "raster string, row long, col long, code int"), ["tile"]).collect()
    assert {r.raster: r.code for r in rows if r.lon is not None} == want | {"unread": None, "strange": None, "degrees": 7}
    assert [r.code for r in rows if r.lon is None] == [None] * 4 and len(rows) == 13
