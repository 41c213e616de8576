"""Queries over label rasters, class profiles and coordinates."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtide.constants import (
    ASSETS, COMMON_OTHER_CROPS, DISPLAY_CLASSES, NON_CROP_CLASSES, OTHER_CROPS,
    TARGETED_CROPS,
)
from fieldtide.functions import geo
from fieldtide.operators import classes as cl, raster as rs
from fieldtide.plans import oracle as o
from fieldtide.plans.registry import query
from fieldtide.session import shared_folder
from fieldtide.sources import aoi, derived, sinks
from fieldtide.sources.derived import CLASS_BY_KEY

ORIGIN_X, ORIGIN_Y, CELL = 480000.0, 1540000.0, 30.0
_DECODED = """decoded AS (SELECT c."row", c.col, c.code, l."Class_Names" AS class_name,
  coalesce(l."ESRI_Red", 0) AS red, coalesce(l."ESRI_Green", 0) AS green, coalesce(l."ESRI_Blue", 0) AS blue
  FROM cells c LEFT JOIN (SELECT * FROM legend WHERE "Class_Names" IS NOT NULL) l ON c.code = l."Codes")"""
_K = geo.albers_constants()


def _albers_sql(x: str, y: str) -> tuple[str, str]:
    rest = f"({_K['rho0']!r}::DOUBLE - ({y}))"
    rho = f"sqrt(({x})*({x}) + {rest}*{rest})"
    q = f"(({_K['c']!r}::DOUBLE - pow({rho}*{_K['n']!r}::DOUBLE/{geo.EARTH_RADIUS!r}::DOUBLE, 2))/{_K['n']!r}::DOUBLE)"
    b = f"asin({q}/{_K['qp']!r}::DOUBLE)"
    lat = (f"degrees({b} + sin({b}*2)*{_K['s2']!r}::DOUBLE + sin({b}*4)*{_K['s4']!r}::DOUBLE "
           f"+ sin({b}*6)*{_K['s6']!r}::DOUBLE)")
    return f"(degrees(atan2(({x}), {rest})/{_K['n']!r}::DOUBLE) - 96e0)", lat


_X, _Y = f"((col + 0.5e0)*{CELL}e0 + {ORIGIN_X}::DOUBLE)", f"({ORIGIN_Y}::DOUBLE - (\"row\" + 0.5e0)*{CELL}e0)"
_LON, _LAT = _albers_sql(_X, _Y)


def _cells(spark, sf_dir):
    return derived.cells(spark, sf_dir)


def _decoded(spark, sf_dir):
    return rs.decode_classes(_cells(spark, sf_dir), derived.legend(spark))


@query("legend_dim", o.with_(o.CELLS, o.LEGEND, select="""
SELECT l."Codes", l."Class_Names", l."ESRI_Red", l."ESRI_Green", l."ESRI_Blue", count(c.code) AS cells
FROM legend l LEFT JOIN cells c ON c.code = l."Codes" WHERE l."Class_Names" IS NOT NULL GROUP BY ALL"""))
def legend_dim(spark, sf_dir):
    counts = _cells(spark, sf_dir).groupBy(F.col("code").alias("Codes")).agg(
        F.count(F.lit(1)).alias("cells"))
    return aoi.legend_dim(derived.legend(spark)).join(counts, "Codes", "left").fillna(
        0, subset=["cells"])


@query("raster_cells", o.with_(o.CELLS, select=f"""
SELECT "row", col, code, round({_X}, 6) AS x, round({_Y}, 6) AS y, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM cells"""))
def raster_cells(spark, sf_dir):
    c = rs.raster_cells(_cells(spark, sf_dir), ORIGIN_X, ORIGIN_Y, CELL)
    return c.select("row", "col", "code", *[F.round(n, 6).alias(n) for n in ("x", "y", "lon", "lat")])


@query("grid_sample", o.with_(o.CELLS, select="""
SELECT "row", col, code FROM cells WHERE "row" >= 1 AND col >= 1 AND ("row" - 1) % 3 = 0 AND (col - 1) % 3 = 0"""))
def grid_sample(spark, sf_dir):
    return rs.grid_sample(_cells(spark, sf_dir), 3, 1).select("row", "col", "code")


@query("grid_restore", o.with_(o.CELLS, """
shape AS (SELECT (max("row") + 1) AS rows FROM cells)""", """
grid AS (SELECT unnest(range(0, (SELECT rows*50 FROM shape))) AS id)""", """
samples AS (SELECT ("row" - 2)//3 AS i, (col - 2)//3 AS j, code FROM cells
  WHERE "row" >= 2 AND col >= 2 AND ("row" - 2) % 3 = 0 AND (col - 2) % 3 = 0)""", select="""
SELECT id // 50 AS "row", id % 50 AS col, coalesce(code, 0)::INTEGER AS code FROM grid
LEFT JOIN samples ON id // 50 = i*3 + 1 AND id % 50 = j*3 + 1"""))
def grid_restore(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    rows = cells.agg(F.max("row") + 1).first()[0]
    samples = rs.grid_sample(cells, 3, 2).select(
        F.floor((F.col("row") - 2) / 3).alias("i"), F.floor((F.col("col") - 2) / 3).alias("j"), "code")
    return rs.grid_restore(samples, rows, 50, 3)


@query("decode_classes", o.with_(o.CELLS, o.LEGEND, _DECODED, select="SELECT * FROM decoded"))
def decode_classes(spark, sf_dir):
    return _decoded(spark, sf_dir)


@query("sample_raster_at_points", o.with_(o.CELLS, """
pts AS (SELECT l_orderkey % 45 AS "row", l_partkey % 52 AS col FROM lineitem)""", select="""
SELECT p."row", p.col, c.code, count(*) AS points FROM pts p LEFT JOIN cells c USING ("row", col) GROUP BY ALL"""))
def sample_raster_at_points(spark, sf_dir):
    pts = derived.table(spark, sf_dir, "lineitem").select(
        (F.lit(ORIGIN_X) + (F.col("l_partkey") % 52) * CELL + 7).alias("x"),
        (F.lit(ORIGIN_Y) - (F.col("l_orderkey") % 45) * CELL - 11).alias("y"))
    hit = rs.sample_at_points(
        rs.counted_points(pts), _cells(spark, sf_dir), F.col("x"), F.col("y"), ORIGIN_X, ORIGIN_Y, CELL)
    return hit.groupBy("row", "col", "code").agg(F.sum("points").alias("points"))


@query("crop_window", o.with_(o.CELLS, select="""
SELECT "row", col, code FROM cells WHERE "row" BETWEEN 0 AND 19 AND col BETWEEN 0 AND 19"""))
def crop_window(spark, sf_dir):
    return rs.crop_window(_cells(spark, sf_dir), 20).select("row", "col", "code")


@query("sample_rasters_at_points", o.with_(o.CELLS, """
pts AS (SELECT l_orderkey % 45 AS "row", l_partkey % 52 AS col, unnest(range(4)) AS raster FROM lineitem)""", """
all_cells AS (SELECT *, unnest(range(3)) AS raster FROM cells)""", select="""
SELECT p.raster::INTEGER AS raster, p."row", p.col, c.code + c.raster::INTEGER AS code, count(*) AS points
FROM pts p LEFT JOIN all_cells c USING (raster, "row", col) GROUP BY ALL"""))
def sample_rasters_at_points(spark, sf_dir):
    """Three rasters in one join; the fourth could not be read and gives nulls."""
    ids = lambda n: F.explode(F.array(*map(F.lit, range(n)))).alias("raster")
    pts = derived.table(spark, sf_dir, "lineitem").select(
        (F.lit(ORIGIN_X) + (F.col("l_partkey") % 52) * CELL + 7).alias("x"),
        (F.lit(ORIGIN_Y) - (F.col("l_orderkey") % 45) * CELL - 11).alias("y"))
    pts = rs.counted_points(pts).select("*", ids(4))
    cells = _cells(spark, sf_dir).select("row", "col", "code", ids(3)).withColumn(
        "code", F.col("code") + F.col("raster"))
    hit = rs.sample_at_points(
        pts, cells, F.col("x"), F.col("y"), ORIGIN_X, ORIGIN_Y, CELL, ["raster"])
    return hit.groupBy("raster", "row", "col", "code").agg(F.sum("points").alias("points"))


#: Rasters of two tiles, each in the zone of its tile at three cell sizes, and one per tile that
#: could not be read: (tile, raster, epsg, origin_x, origin_y, cell).
GRIDS = [
    (tile, f"{tile}-{cell}", epsg, x, y, float(cell))
    for tile, epsg, x, y in (("15SYV", 32615, 717_500.0, 3_933_800.0), ("16SBE", 32616, 173_500.0, 3_936_400.0))
    for cell in (10, 20, 60, 30)]
UNREAD = 30
_LON0, _LAT0 = "(-90.6e0 + (l_suppkey % 100)*0.0003e0)", "(35.5e0 + (l_partkey % 200)*0.0001e0)"


def _mercator_sql() -> tuple[str, str]:
    """Easting and northing of lon, lat in the zone of epsg, from the same constants."""
    k = geo.mercator_series(geo.WGS84_FLATTENING)
    size = f"{geo.UTM_SCALE * geo.EARTH_RADIUS * k['a']!r}::DOUBLE"
    real = " + ".join(f"sin(xi*{2 * j})*cosh(eta*{2 * j})*{c!r}::DOUBLE" for j, c in enumerate(k["forward"], 1))
    imaginary = " + ".join(f"cos(xi*{2 * j})*sinh(eta*{2 * j})*{c!r}::DOUBLE" for j, c in enumerate(k["forward"], 1))
    return f"(500000e0 + (eta + {imaginary})*{size})", f"((xi + {real})*{size})"


_EAST, _NORTH = _mercator_sql()
_E = repr(geo.mercator_series(geo.WGS84_FLATTENING)["e"]) + "::DOUBLE"
_PLACED = [
    "grids(tile, raster, epsg, ox, oy, cell) AS (VALUES " + ", ".join(
        f"('{t}', '{r}', {e}, {x!r}::DOUBLE, {y!r}::DOUBLE, {c!r}::DOUBLE)" for t, r, e, x, y, c in GRIDS) + ")",
    f"""pts AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN '15SYV' ELSE '16SBE' END AS tile,
  {_LON0} AS lon, {_LAT0} AS lat FROM lineitem)""",
    f"""turned AS (SELECT *, sinh(atanh(sin(radians(lat))) - atanh(sin(radians(lat))*{_E})*{_E}) AS t,
  radians(lon - ((epsg % 100)*6 - 183)) AS along FROM pts JOIN grids USING (tile))""",
    "angles AS (SELECT *, atan2(t, cos(along)) AS xi, atanh(sin(along)/sqrt(t*t + 1)) AS eta FROM turned)",
    f"""placed AS (SELECT raster, floor((oy - {_NORTH})/cell)::BIGINT AS "row", floor(({_EAST} - ox)/cell)::BIGINT AS col,
  raster LIKE '%-{UNREAD}' AS failed FROM angles)""",
]


@query("sample_rasters_by_crs", o.with_(o.CELLS, *_PLACED, select="""
SELECT raster, p."row", p.col, CASE WHEN NOT failed THEN c.code END AS code, count(*) AS points
FROM placed p LEFT JOIN cells c ON p."row" = c."row" AND p.col = c.col GROUP BY ALL"""))
def sample_rasters_by_crs(spark, sf_dir):
    """Every point in all rasters of its tile: two zones, three cell sizes, one failed raster."""
    grids = spark.createDataFrame(
        GRIDS, "tile string, raster string, epsg int, origin_x double, origin_y double, cell double")
    pts = derived.table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "15SYV").otherwise("16SBE").alias("tile"),
        F.expr(_LON0).alias("lon"), F.expr(_LAT0).alias("lat"))
    read = [g[1] for g in GRIDS if g[5] != UNREAD]
    cells = _cells(spark, sf_dir).select("row", "col", "code", F.explode(F.array(*map(F.lit, read))).alias("raster"))
    hit = rs.sample_rasters(rs.counted_points(pts), grids, cells, ["tile"])
    return hit.groupBy("raster", "row", "col", "code").agg(F.sum("points").alias("points"))


@query("utm_cells", o.with_(o.CELLS, select=f"""
SELECT "row", col, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM cells"""))
def utm_cells(spark, sf_dir):
    """Cell centres through zone 15 and back are where they were."""
    c = rs.raster_cells(_cells(spark, sf_dir), ORIGIN_X, ORIGIN_Y, CELL)
    x, y = geo.lonlat_to_crs(F.col("lon"), F.col("lat"), F.lit(32615))
    lon, lat = geo.crs_to_lonlat(F.col("east"), F.col("north"), F.lit(32615))
    there = c.select("row", "col", x.alias("east"), y.alias("north"))
    return there.select("row", "col", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query("random_crop", o.with_(o.CELLS, """
corner AS (SELECT ('0x' || substr(md5('42|top'), 1, 8))::BIGINT % greatest(1, max("row") - 10) AS t,
  ('0x' || substr(md5('42|left'), 1, 8))::BIGINT % greatest(1, max(col) - 10) AS l FROM cells)""", select="""
SELECT "row", col, code FROM cells, corner WHERE "row" BETWEEN t AND t + 11 AND col BETWEEN l AND l + 11"""))
def random_crop(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    rows, cols = cells.agg(F.max("row") + 1, F.max("col") + 1).first()
    return rs.crop_window(cells, 12, *rs.random_corner(rows, cols, 12, 42)).select("row", "col", "code")


@query("cell_centre", o.with_(o.CELLS, select=f"""
SELECT "row", col, round({_X}, 6) AS x, round({_Y}, 6) AS y,
  floor(({ORIGIN_Y}::DOUBLE - {_Y})/{CELL}e0)::BIGINT AS back_row, floor(({_X} - {ORIGIN_X}::DOUBLE)/{CELL}e0)::BIGINT AS back_col FROM cells"""))
def cell_centre(spark, sf_dir):
    x, y = geo.cell_centre(F.col("row"), F.col("col"), ORIGIN_X, ORIGIN_Y, CELL)
    row, col = geo.cell_index(x, y, ORIGIN_X, ORIGIN_Y, CELL)
    return _cells(spark, sf_dir).select(
        "row", "col", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"),
        row.alias("back_row"), col.alias("back_col"))


_CX = "split_part(bbox, ',', {})::DOUBLE"
_C1, _C2 = _albers_sql(_CX.format(1), _CX.format(2)), _albers_sql(_CX.format(3), _CX.format(4))


@query("albers_to_lonlat", o.with_(o.OBS, select=f"""
SELECT bbox, round({_C1[0]}, 6) AS min_lon, round({_C1[1]}, 6) AS min_lat, round({_C2[0]}, 6) AS max_lon,
  round({_C2[1]}, 6) AS max_lat, count(*) AS n FROM obs GROUP BY bbox"""))
def albers_to_lonlat(spark, sf_dir):
    b = geo.parse_bbox(F.col("bbox"))
    lo, hi = geo.albers_to_lonlat(b[0], b[1]), geo.albers_to_lonlat(b[2], b[3])
    named = zip(("min_lon", "min_lat", "max_lon", "max_lat"), (*lo, *hi))
    return derived.observations(spark, sf_dir).groupBy("bbox").agg(
        F.count(F.lit(1)).alias("n")).select(
        "bbox", "n", *[F.round(c, 6).alias(n) for n, c in named])


@query("web_mercator", o.with_(o.OBS, select="""
SELECT lon, lat, round(radians(lon)*6378137e0, 3) AS x, round(ln(tan(radians(lat)/2 + pi()/4))*6378137e0, 3) AS y,
  count(*) AS n FROM obs GROUP BY lon, lat"""))
def web_mercator(spark, sf_dir):
    x, y = geo.web_mercator(F.col("lon"), F.col("lat"))
    return derived.observations(spark, sf_dir).groupBy("lon", "lat").agg(
        F.count(F.lit(1)).alias("n")).select(
        "lon", "lat", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), "n")


# --- distributions -------------------------------------------------------------

_DIST = """dist AS (SELECT aoi, class_name, count(*) AS "count", count(*)*100e0/sum(count(*)) OVER (PARTITION BY aoi) AS "percent"
  FROM (SELECT *, CASE WHEN "row" % 2 = 0 THEN 'even' ELSE 'odd' END AS aoi FROM decoded) GROUP BY aoi, class_name)"""


def _by_aoi(spark, sf_dir):
    return _decoded(spark, sf_dir).withColumn(
        "aoi", F.when(F.col("row") % 2 == 0, "even").otherwise("odd"))


@query("class_distribution", o.with_(o.CELLS, o.LEGEND, _DECODED, select="""
SELECT class_name, count(*) AS "count", round(count(*)*100e0/sum(count(*)) OVER (), 6) AS "percent" FROM decoded GROUP BY class_name
QUALIFY count(*)*100e0/sum(count(*)) OVER () >= 1"""))
def class_distribution(spark, sf_dir):
    return cl.class_distribution(_decoded(spark, sf_dir)).withColumn(
        "percent", F.round("percent", 6))


@query("aoi_stats_wide", o.with_(o.CELLS, o.LEGEND, _DECODED, _DIST, select="SELECT aoi, " + ", ".join(
    f"max(trunc(\"percent\")::INTEGER) FILTER (class_name = '{c}') AS \"{c}\"" for c in CLASS_BY_KEY[:10])
    + " FROM dist WHERE \"percent\" >= 1 GROUP BY aoi"))
def aoi_stats_wide(spark, sf_dir):
    dist = cl.class_distribution(_by_aoi(spark, sf_dir), "aoi")
    return cl.aoi_stats_wide(dist, CLASS_BY_KEY[:10], "aoi")


def _percent_of(name: str, where: str) -> str:
    return f"max(trunc(\"percent\")::INTEGER) FILTER (class_name = '{name}' AND aoi = '{where}') AS \"{name}\""


@query("union_stats", o.with_(o.CELLS, o.LEGEND, _DECODED, _DIST, select="SELECT aoi, " + ", ".join(
    _percent_of(c, "even" if i < 5 else "odd") for i, c in enumerate(CLASS_BY_KEY[:10]))
    + " FROM dist WHERE \"percent\" >= 1 GROUP BY aoi"))
def union_stats(spark, sf_dir):
    """Stack two tables with different class columns; absent classes become null."""
    dist = cl.class_distribution(_by_aoi(spark, sf_dir), "aoi")
    even = cl.aoi_stats_wide(dist.where(F.col("aoi") == "even"), CLASS_BY_KEY[:5], "aoi")
    odd = cl.aoi_stats_wide(dist.where(F.col("aoi") == "odd"), CLASS_BY_KEY[5:10], "aoi")
    return even.unionByName(odd, allowMissingColumns=True)


@query("class_share_by_year", o.with_(o.OBS, select="""
SELECT "year", CDL, count(*) AS "count", (sum(count(*)) OVER (PARTITION BY "year"))::BIGINT AS total,
  round(count(*)*100e0/sum(count(*)) OVER (PARTITION BY "year"), 2) AS "percent" FROM obs GROUP BY "year", CDL"""))
def class_share_by_year(spark, sf_dir):
    return cl.class_share_by_year(derived.observations(spark, sf_dir))


@query("count_by_class_year", o.with_(o.OBS, select='SELECT CDL, "year", count(*) AS "count" FROM obs GROUP BY ALL'))
def count_by_class_year(spark, sf_dir):
    return cl.count_by_class_year(derived.observations(spark, sf_dir))


@query("year_summary", o.with_(o.OBS, select='SELECT "year", count(*) AS "rows", ' + ", ".join(
    f"round(avg({c}), 6) AS mean_{c}" for c in ["lon", "lat", *ASSETS]) + ' FROM obs GROUP BY "year"'))
def year_summary(spark, sf_dir):
    s = cl.year_summary(derived.observations(spark, sf_dir), ["lon", "lat", *ASSETS])
    return s.select("year", "rows", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


@query("value_histogram", o.with_(o.CELLS, select='SELECT code, count(*) AS "count" FROM cells GROUP BY code'))
def value_histogram(spark, sf_dir):
    return rs.value_histogram(_cells(spark, sf_dir))


@query("asset_profile", o.with_(o.OBS, o.MASKED, select=" UNION ALL ".join(
    f"SELECT '{a}' AS asset, min({a}) AS \"min\", max({a}) AS \"max\", count(DISTINCT {a}) AS distinct_values FROM masked"
    for a in ASSETS)))
def asset_profile(spark, sf_dir):
    from fieldtide.plans.series_queries import masked

    return cl.asset_profile(masked(spark, sf_dir))


@query("asset_sketches", o.with_(o.OBS, select=" UNION ALL ".join(
    f"SELECT '{a}' AS asset, min({a}) AS \"min\", max({a}) AS \"max\", count(DISTINCT {a}) AS distinct_values, TRUE AS within_bound FROM obs"
    for a in ASSETS)))
def asset_sketches(spark, sf_dir):
    """Sketches of the years before 1996, of the other years when they are there; exact counts beside them."""
    root = shared_folder(spark, "sketched")
    obs = derived.observations(spark, sf_dir)
    for part in (obs.where("year < 1996"), obs.where("year >= 1996")):
        sinks.append_observations(part, f"{root}/observations", ["bbox", "year"])
        cl.refresh_sketches(spark, f"{root}/observations", f"{root}/sketches")
    found = cl.sketch_profile(spark.read.parquet(f"{root}/sketches"))
    exact = cl.asset_profile(obs).select("asset", F.col("distinct_values").alias("exact"))
    error = F.abs(F.col("distinct_values") / F.col("exact") - 1)
    return found.join(exact, "asset").select(
        "asset", "min", "max", F.col("exact").alias("distinct_values"), (error < 0.05).alias("within_bound"))


_NON_CROP = f"list_bool_or([contains(CDL, w) FOR w IN {o.strings(NON_CROP_CLASSES)}])"
_PROFILE = f"""profile AS (SELECT CDL, n AS "count", kind, n*100e0/sum(n) OVER () AS "percent",
  row_number() OVER (PARTITION BY kind ORDER BY n DESC, CDL) AS rank,
  list_contains({o.strings(COMMON_OTHER_CROPS)}, CDL) AS common_other FROM
  (SELECT CDL, count(*) AS n, CASE WHEN {_NON_CROP} THEN 'non_crop' ELSE 'crop' END AS kind FROM obs GROUP BY CDL))"""


@query("class_profile", o.with_(o.OBS, _PROFILE, select="""
SELECT CDL, "count", kind, round("percent", 6) AS "percent", rank, common_other FROM profile"""))
def class_profile(spark, sf_dir):
    return cl.class_profile(derived.observations(spark, sf_dir)).withColumn(
        "percent", F.round("percent", 6))


@query("top_classes", o.with_(o.OBS, _PROFILE, select="""
SELECT CDL, "count", kind, rank FROM profile WHERE (kind = 'crop' AND rank <= 50) OR (kind = 'non_crop' AND rank <= 20)"""))
def top_classes(spark, sf_dir):
    p = cl.class_profile(derived.observations(spark, sf_dir))
    return cl.top_classes(p, 50, 20).select("CDL", "count", "kind", "rank")


@query("suggest_classes", o.with_(o.OBS, _PROFILE, """
crops AS (SELECT *, CASE WHEN rank <= 10 AND NOT common_other THEN 'targeted' ELSE 'other' END AS grp FROM profile WHERE kind = 'crop')""", """
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank > 10, rank) AS pos FROM crops)""", """
kept AS (SELECT * FROM placed WHERE (grp = 'targeted' AND pos <= 6) OR (grp = 'other' AND pos <= 20))""", select="""
SELECT grp || '_crops' AS section, pos::INTEGER AS "position", CDL AS name, "count" FROM kept
UNION ALL SELECT 'label_legend', (pos + 3)::INTEGER, CDL, "count" FROM kept WHERE grp = 'targeted'
UNION ALL SELECT 'label_legend', i, n, NULL FROM (VALUES (1, 'Uncultivated'), (2, 'Cultivated'), (3, 'No Crop Growing')) t(i, n)"""))
def suggest_classes(spark, sf_dir):
    return cl.suggest_classes(cl.class_profile(derived.observations(spark, sf_dir)))


@query("class_difference", o.with_(o.OBS, select=f"""
SELECT DISTINCT CDL FROM obs WHERE NOT list_contains({o.strings([*TARGETED_CROPS, *OTHER_CROPS])}, CDL)"""))
def class_difference(spark, sf_dir):
    return cl.class_difference(derived.observations(spark, sf_dir))


@query("class_overlap", o.with_(o.OBS, select="""
SELECT CDL, CASE WHEN bool_or(b) AND bool_or(NOT b) THEN 'both' WHEN bool_or(b) THEN 'only_train' ELSE 'only_test' END AS found_in
FROM (SELECT CDL, bbox LIKE '390000%' OR bbox LIKE '410000%' AS b FROM obs) GROUP BY CDL"""))
def class_overlap(spark, sf_dir):
    obs = derived.observations(spark, sf_dir)
    west = F.col("bbox").startswith("390000") | F.col("bbox").startswith("410000")
    return cl.class_overlap(obs.where(west), obs.where(~west))


@query("encode_cdl", o.with_(o.OBS, select=f"""
SELECT CDL, (CASE WHEN list_contains({o.strings(DISPLAY_CLASSES)}, CDL) THEN list_position({o.strings(DISPLAY_CLASSES)}, CDL) - 1
  ELSE {len(DISPLAY_CLASSES) - 1} END)::INTEGER AS encoded, count(*) AS n FROM obs GROUP BY ALL"""))
def encode_cdl(spark, sf_dir):
    return cl.encode_cdl(derived.observations(spark, sf_dir)).groupBy("CDL", "encoded").agg(
        F.count(F.lit(1)).alias("n"))
