"""Coordinates: AOI text, cell grids and the two projections the maps need."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtide.functions import vectors

EARTH_RADIUS = 6378137.0

# Conus Albers equal area on the GRS80 ellipsoid: fixed values (EPSG:5070).
GRS80_FLATTENING = 1 / 298.257222101
ALBERS_PARALLELS = (29.5, 45.5)
ALBERS_ORIGIN = (23.0, -96.0)

# Universal transverse Mercator on the WGS84 ellipsoid: fixed values (EPSG:326zz and 327zz).
WGS84_FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500_000.0
UTM_SOUTH_NORTHING = 10_000_000.0


def parse_bbox(text: Column) -> Column:
    """"a,b,c,d" (blanks allowed) to four integers."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("bigint"))


def format_bbox(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Bounds truncated to whole units and joined by commas."""
    return F.concat_ws(",", *[
        x.cast("bigint").cast("string") for x in (min_x, min_y, max_x, max_y)])


def cell_centre(row: Column, col: Column, origin_x: float, origin_y: float, size: float):
    """Centre of a cell of a north-up grid as (x, y)."""
    return ((col + 0.5) * size + origin_x, F.lit(origin_y) - (row + 0.5) * size)


def cell_index(x: Column, y: Column, origin_x: float, origin_y: float, size: float):
    """(row, col) of the cell that holds a point."""
    return (F.floor((F.lit(origin_y) - y) / size), F.floor((x - origin_x) / size))


def web_mercator(lon: Column, lat: Column):
    """Spherical Mercator metres."""
    return (
        F.radians(lon) * EARTH_RADIUS,
        F.ln(F.tan(F.radians(lat) / 2 + math.pi / 4)) * EARTH_RADIUS,
    )


def albers_constants() -> dict[str, float]:
    """Cone constant, integration constant and origin radius of the projection."""
    e2 = GRS80_FLATTENING * (2 - GRS80_FLATTENING)
    e = math.sqrt(e2)

    def q(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (
            s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m(phi: float) -> float:
        s = math.sin(phi)
        return math.cos(phi) / math.sqrt(1 - e2 * s * s)

    p1, p2 = (math.radians(p) for p in ALBERS_PARALLELS)
    n = (m(p1) ** 2 - m(p2) ** 2) / (q(p2) - q(p1))
    big_c = m(p1) ** 2 + n * q(p1)
    rho0 = EARTH_RADIUS * math.sqrt(big_c - n * q(math.radians(ALBERS_ORIGIN[0]))) / n
    return {
        "n": n, "c": big_c, "rho0": rho0, "qp": q(math.pi / 2),
        # series from authalic to geodetic latitude
        "s2": e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040,
        "s4": 23 * e2**2 / 360 + 251 * e2**3 / 3780,
        "s6": 761 * e2**3 / 45360,
    }


def albers_to_lonlat(x: Column, y: Column):
    """Inverse Albers equal area; (lon, lat) in degrees."""
    k = albers_constants()
    x, y = x.cast("double"), y.cast("double")
    rest = F.lit(k["rho0"]) - y
    rho = F.sqrt(x * x + rest * rest)
    q = (F.lit(k["c"]) - F.pow(rho * k["n"] / EARTH_RADIUS, 2)) / k["n"]
    beta = F.asin(q / k["qp"])
    lat = (beta + F.sin(beta * 2) * k["s2"] + F.sin(beta * 4) * k["s4"]
           + F.sin(beta * 6) * k["s6"])
    lon = F.degrees(F.atan2(x, rest) / k["n"]) + ALBERS_ORIGIN[1]
    return lon, F.degrees(lat)


def mercator_series(flattening: float) -> dict[str, float | list[float]]:
    """Constants of the Krüger series to the fourth order of the third flattening n.

    a: rectifying radius per unit of the equatorial one; forward, back: from conformal to
    rectified coordinates and back; lat: from conformal to geodetic latitude. Beyond the fourth
    order less than a micrometre is left within 3000 km of the central meridian.
    """
    n = flattening / (2 - flattening)
    return {
        "e": math.sqrt(flattening * (2 - flattening)),
        "a": (1 + n**2 / 4 + n**4 / 64) / (1 + n),
        "forward": [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280],
        "back": [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280],
        "lat": [
            2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
            7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
            56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630],
    }


def _complex_sine(c: list[float], xi: Column, eta: Column) -> tuple[Column, Column]:
    """Real and imaginary part of the sum of c[j] sin(2 (j + 1) (xi + i eta))."""
    real, imaginary = F.lit(0.0), F.lit(0.0)
    for j, k in enumerate(c, 1):
        real += F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * k
        imaginary += F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * k
    return real, imaginary


def transverse_mercator(
    lon: Column, lat: Column, meridian: Column, scale: float = UTM_SCALE,
    radius: float = EARTH_RADIUS, flattening: float = WGS84_FLATTENING,
) -> tuple[Column, Column]:
    """(x, y) in metres from the central meridian and the equator."""
    k = mercator_series(flattening)
    sine = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(sine) - F.atanh(sine * k["e"]) * k["e"])

    def angles(v: Column) -> Column:
        return F.struct(F.atan2(v["t"], F.cos(v["along"])).alias("xi"),
                        F.atanh(F.sin(v["along"]) / F.sqrt(v["t"] * v["t"] + 1)).alias("eta"))

    def metres(v: Column) -> Column:
        real, imaginary = _complex_sine(k["forward"], v["xi"], v["eta"])
        return F.struct(((v["eta"] + imaginary) * (scale * radius * k["a"])).alias("x"),
                        ((v["xi"] + real) * (scale * radius * k["a"])).alias("y"))

    # each step once per row: written out, t alone would stand in the result some thirty times
    placed = vectors.let(vectors.let(
        F.struct(t.alias("t"), F.radians(lon - meridian).alias("along")), angles), metres)
    return placed["x"], placed["y"]


def inverse_transverse_mercator(
    x: Column, y: Column, meridian: Column, scale: float = UTM_SCALE,
    radius: float = EARTH_RADIUS, flattening: float = WGS84_FLATTENING,
) -> tuple[Column, Column]:
    """(lon, lat) in degrees of metres from the central meridian and the equator."""
    k = mercator_series(flattening)
    xi, eta = y / (scale * radius * k["a"]), x / (scale * radius * k["a"])
    real, imaginary = _complex_sine(k["back"], xi, eta)
    xi, eta = xi - real, eta - imaginary
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(k["lat"], 1):
        lat += F.sin(chi * (2 * j)) * d
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + meridian, F.degrees(lat)


def utm_meridian(epsg: Column) -> Column:
    """Central meridian of a UTM zone by its EPSG code; null for any other system."""
    utm = epsg.between(32601, 32660) | epsg.between(32701, 32760)
    return F.when(utm, (epsg % 100) * 6 - 183)


def _southern(epsg: Column) -> Column:
    return F.when(epsg >= 32700, UTM_SOUTH_NORTHING).otherwise(0.0)


def lonlat_to_crs(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """(x, y) in the system of each row: a UTM zone, or degrees (4326). Others give null."""
    x, y = transverse_mercator(lon, lat, utm_meridian(epsg))
    degrees = epsg == 4326
    return (F.when(degrees, lon).otherwise(x + UTM_FALSE_EASTING),
            F.when(degrees, lat).otherwise(y + _southern(epsg)))


def crs_to_lonlat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of coordinates in the system of each row, as in `lonlat_to_crs`."""
    lon, lat = inverse_transverse_mercator(
        x - UTM_FALSE_EASTING, y - _southern(epsg), utm_meridian(epsg))
    degrees = epsg == 4326
    return F.when(degrees, x).otherwise(lon), F.when(degrees, y).otherwise(lat)


def polygon_bounds(points: Column) -> tuple[Column, Column, Column, Column]:
    """min x, min y, max x, max y of an array of struct(x, y)."""
    xs, ys = points.getField("x"), points.getField("y")
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def convex_overlap(a: Column, b: Column) -> Column:
    """Whether two convex polygons (arrays of struct(x, y), open or closed) share a point.

    Separating axis test: they are apart exactly if the normal of one edge tells them apart.
    Touching polygons overlap. Null or empty polygons give null.
    """
    def normals(p: Column) -> Column:
        def normal(v: Column, i: Column) -> Column:
            to = F.get(p, F.pmod(i + 1, F.size(p)))
            return F.struct((to["y"] - v["y"]).alias("x"), (v["x"] - to["x"]).alias("y"))

        return F.transform(p, normal)

    def along(p: Column, n: Column) -> Column:
        return F.transform(p, lambda v: v["x"] * n["x"] + v["y"] * n["y"])

    def apart(n: Column) -> Column:
        return (F.array_max(along(a, n)) < F.array_min(along(b, n))) | (F.array_max(along(b, n)) < F.array_min(along(a, n)))

    filled = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(filled, ~F.exists(F.concat(normals(a), normals(b)), apart))
