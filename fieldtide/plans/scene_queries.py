"""Queries over the scene catalog, AOIs and stored partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtide.constants import ASSETS, COVERAGE_KEYS, SCENE
from fieldtide.functions import geo, text
from fieldtide.operators import quality, scenes as sc
from fieldtide.plans import oracle as o
from fieldtide.plans.registry import query
from fieldtide.session import shared_folder
from fieldtide.sources import aoi, derived, tables, sinks

_BASE = "regexp_extract(id, '^(.*)_[^_]*_[^_]*$', 1)"
_TILE = "(split_part(id, '_', 2) || '_' || split_part(id, '_', 4))"
_PCT = " + ".join(f"coalesce(json_extract_string(properties, '$.\"{k}\"')::DOUBLE, 0)" for k in COVERAGE_KEYS)


def _catalog(spark, sf_dir):
    return derived.scenes(spark, sf_dir)


def _aoi(spark):
    return aoi.parse_aoi(derived.aoi_lines(spark))


@query("catalog_search", o.with_(o.SCENES, select="""
SELECT id, seq, datetime FROM scenes WHERE min_lon <= -90.3e0 AND max_lon >= -90.6e0 AND min_lat <= 35.3e0
  AND max_lat >= 35.1e0 AND datetime BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'"""))
def catalog_search(spark, sf_dir):
    return sc.catalog_search(
        _catalog(spark, sf_dir), (-90.6, 35.1, -90.3, 35.3), "2024-01-05 00:00:00",
        "2024-01-20 23:59:59").select("id", "seq", "datetime")


_TILT = "(user_id % 5)*0.01e0"
_AX, _AY = "-91e0 + (n_nationkey % 5)*0.2e0", "35e0 + (n_nationkey // 5)*0.1e0"
_SIDE = """SELECT {id}, i, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS tx, coalesce(lead(y) OVER w, first(y) OVER w) AS ty
  FROM {source} WINDOW w AS (PARTITION BY {id} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query("footprint_search", o.with_(o.SCENES, f"""
kinds AS (SELECT DISTINCT user_id % 100 AS kind, min_lon, min_lat, max_lon, max_lat, {_TILT} AS t FROM scenes)""", """
corners AS (SELECT kind, 1 AS i, min_lon + t AS x, max_lat AS y FROM kinds UNION ALL SELECT kind, 2, max_lon, max_lat - t FROM kinds
  UNION ALL SELECT kind, 3, max_lon - t, min_lat FROM kinds UNION ALL SELECT kind, 4, min_lon, min_lat + t FROM kinds)""", f"""
points AS (SELECT n_nationkey AS area, 1 AS i, {_AX} AS x, {_AY} AS y FROM nation
  UNION ALL SELECT n_nationkey, 2, {_AX} + 0.07e0, {_AY} + 0.02e0 FROM nation
  UNION ALL SELECT n_nationkey, 3, {_AX} + 0.01e0, {_AY} + 0.06e0 FROM nation)""",
    f"ks AS ({_SIDE.format(id='kind', source='corners')})", f"pts AS ({_SIDE.format(id='area', source='points')})", """
axes AS (SELECT kind, area, ks.ty - ks.y AS nx, ks.x - ks.tx AS ny FROM ks, (SELECT DISTINCT area FROM points)
  UNION SELECT kind, area, pts.ty - pts.y, pts.x - pts.tx FROM pts, (SELECT DISTINCT kind FROM corners))""", """
spans AS (SELECT a.kind, a.area, nx, ny, min(c.x*nx + c.y*ny) AS c0, max(c.x*nx + c.y*ny) AS c1,
  min(p.x*nx + p.y*ny) AS p0, max(p.x*nx + p.y*ny) AS p1
  FROM axes a JOIN corners c ON c.kind = a.kind JOIN points p ON p.area = a.area GROUP BY ALL)""", """
meets AS (SELECT kind, area FROM spans GROUP BY ALL HAVING NOT bool_or(c1 < p0 OR p1 < c0))""", select="""
SELECT area, id, seq, datetime FROM scenes JOIN meets ON kind = user_id % 100 WHERE seq % 4 <> 0
  AND datetime BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 23:59:59'"""))
def footprint_search(spark, sf_dir):
    return sc.footprint_search(
        derived.footprints(spark, sf_dir), derived.areas(spark, sf_dir), "2024-01-05 00:00:00",
        "2024-01-20 23:59:59", ["l2a"]).select("area", "id", "seq", "datetime")


@query("parse_scene_id", o.with_(o.SCENES, select=f"""
SELECT id, {_BASE} AS base, split_part(id, '_', 2) AS grid, split_part(id, '_', 4)::INTEGER AS version,
  {_TILE} AS tile, count(*) AS n FROM scenes GROUP BY ALL"""))
def parse_scene_id(spark, sf_dir):
    return sc.parse_scene_id(_catalog(spark, sf_dir)).groupBy(
        "id", "base", "grid", "version", "tile").agg(F.count(F.lit(1)).alias("n"))


@query("scene_date", o.with_(o.SCENES, select="""
SELECT id, datetime::DATE AS scene_date, count(*) AS n FROM scenes GROUP BY ALL"""))
def scene_date(spark, sf_dir):
    return _catalog(spark, sf_dir).groupBy(
        "id", text.scene_date(F.col("datetime")).alias("scene_date")).agg(
        F.count(F.lit(1)).alias("n"))


@query("json_property", o.with_(o.SCENES, select=f"""
SELECT seq, coalesce(json_extract_string(properties, '$."{COVERAGE_KEYS[0]}"')::DOUBLE, 0) AS vegetation,
  coalesce(json_extract_string(properties, '$."{COVERAGE_KEYS[1]}"')::DOUBLE, 0) AS not_vegetated FROM scenes"""))
def json_property(spark, sf_dir):
    doc = F.col("properties")
    return _catalog(spark, sf_dir).select(
        "seq", text.json_property(doc, COVERAGE_KEYS[0]).alias("vegetation"),
        text.json_property(doc, COVERAGE_KEYS[1]).alias("not_vegetated"))


@query("latest_scene_version", o.with_(o.SCENES, select=f"""
SELECT {_BASE} AS base, id, seq, datetime FROM scenes QUALIFY row_number() OVER
  (PARTITION BY {_BASE} ORDER BY split_part(id, '_', 4)::INTEGER DESC, seq) = 1"""))
def latest_scene_version(spark, sf_dir):
    return sc.latest_scene_version(_catalog(spark, sf_dir)).select("base", "id", "seq", "datetime")


@query("one_tile_scenes", o.with_(o.SCENES, f"""
pick AS (SELECT grid FROM (SELECT DISTINCT split_part(id, '_', 2) AS grid FROM scenes)
  ORDER BY ('0x' || substr(md5('42|' || grid), 1, 8))::BIGINT, grid LIMIT 1)""", f"""
latest AS (SELECT {_BASE} AS base, id, seq FROM scenes QUALIFY row_number() OVER
  (PARTITION BY {_BASE} ORDER BY split_part(id, '_', 4)::INTEGER DESC, seq) = 1)""", select="""
SELECT base, id, seq FROM latest WHERE split_part(id, '_', 2) = (SELECT grid FROM pick)"""))
def one_tile_scenes(spark, sf_dir):
    latest = sc.latest_scene_version(_catalog(spark, sf_dir))
    return sc.one_tile_scenes(latest).select("base", "id", "seq")


@query("scene_coverage", o.with_(o.SCENES, select=f"""
SELECT seq, id, {_PCT} AS coverage, array_to_string(list_filter([{', '.join(
    f"CASE WHEN json_extract_string(properties, '$.\"{k}\"') IS NULL THEN '{k}' END" for k in COVERAGE_KEYS)}],
    lambda x: x IS NOT NULL), ',') AS missing FROM scenes WHERE {_PCT} > 30"""))
def scene_coverage(spark, sf_dir):
    return sc.scene_coverage(_catalog(spark, sf_dir)).select(
        "seq", "id", "coverage", F.array_join("missing", ",").alias("missing"))


_DEAD = " + ".join(f"(count({a}) = 0)::INTEGER" for a in ASSETS)


@query("scene_asset_health", o.with_(o.OBS, o.GAPS, select=f"""
SELECT bbox, "year", tile, scene_date, count(*) AS points, ({_DEAD})::INTEGER AS dead_assets
FROM gaps GROUP BY ALL HAVING ({_DEAD}) <= 6.5"""))
def scene_asset_health(spark, sf_dir):
    return quality.scene_asset_health(derived.observation_gaps(spark, sf_dir))


@query("clean_numeric", o.with_(o.OBS, o.GAPS, select=f"""
SELECT {o.KEY}, tile, scene_date, {', '.join(f'{a}::INTEGER AS {a}' for a in ASSETS)} FROM gaps
WHERE {' AND '.join(f'{a} IS NOT NULL' for a in ASSETS)}"""))
def clean_numeric(spark, sf_dir):
    return quality.clean_numeric(derived.observation_gaps(spark, sf_dir))


@query("scl_mask", o.with_(o.OBS, o.MASKED, select="SELECT * FROM masked"))
def scl_mask(spark, sf_dir):
    return quality.scl_mask(derived.observations(spark, sf_dir))


_LONG = " UNION ALL ".join(
    f"SELECT CDL, lon, lat, bbox, \"year\", tile, scene_date, '{a}' AS asset, {a} AS value FROM gaps" for a in ASSETS)


@query("assemble_assets", o.with_(o.OBS, o.GAPS, f"samples AS ({_LONG})", select=f"""
SELECT CDL, lon, lat, bbox, "year", tile, scene_date, {', '.join(
    f"max(value) FILTER (asset = '{a}') AS {a}" for a in ASSETS)} FROM samples GROUP BY ALL"""))
def assemble_assets(spark, sf_dir):
    return quality.assemble_assets(
        derived.asset_samples(spark, sf_dir),
        ["CDL", "lon", "lat", "bbox", "year", "tile", "scene_date"])


# --- stored partitions and what is left to do ----------------------------------

#: Scenes of the first half of each month count as already stored.
_STORED = "day(scene_date) <= 15"


def _stored(obs):
    return obs.where(F.day("scene_date") <= 15)


@query("skip_existing_scenes", o.with_(o.OBS, select=f"""
SELECT bbox, "year", tile, scene_date, count(*) AS images FROM obs o WHERE NOT EXISTS (
  SELECT 1 FROM obs s WHERE {_STORED.replace('scene_date', 's.scene_date')} AND s.bbox = o.bbox AND s."year" = o."year"
    AND s.tile = o.tile AND s.scene_date = o.scene_date) GROUP BY ALL"""))
def skip_existing_scenes(spark, sf_dir):
    obs = derived.observations(spark, sf_dir)
    return sc.skip_existing(obs, _stored(obs), SCENE).groupBy(*SCENE).agg(
        F.count(F.lit(1)).alias("images"))


@query("skip_existing_aoi", o.with_(o.OBS, o.AOI, f"""
grid AS (SELECT b.bbox, y."year" FROM (SELECT DISTINCT bbox FROM aoi) b, (SELECT DISTINCT "year" FROM aoi) y)""",
    select="""
SELECT bbox, "year" FROM grid EXCEPT SELECT bbox, "year" FROM obs WHERE scene_date < DATE '1998-01-01'"""))
def skip_existing_aoi(spark, sf_dir):
    sampled = derived.observations(spark, sf_dir).where(F.col("scene_date") < "1998-01-01")
    return sc.skip_existing(aoi.bbox_year_grid(_aoi(spark)), sampled, ["bbox", "year"])


@query("skip_existing_series", o.with_(o.OBS, select="""
SELECT bbox, "year", count(*) AS images FROM obs WHERE (bbox, "year") NOT IN
  (SELECT bbox, "year" FROM obs WHERE scene_date < DATE '1997-01-01') GROUP BY ALL"""))
def skip_existing_series(spark, sf_dir):
    obs = derived.observations(spark, sf_dir)
    built = obs.where(F.col("scene_date") < "1997-01-01")
    return sc.skip_existing(obs, built, ["bbox", "year"]).groupBy("bbox", "year").agg(
        F.count(F.lit(1)).alias("images"))


@query("complete_bboxes", o.with_(o.OBS, o.AOI, select="""
SELECT bbox, count(DISTINCT "year") AS years FROM obs WHERE "year" IN (SELECT "year" FROM aoi)
GROUP BY bbox HAVING count(DISTINCT "year") = (SELECT count(DISTINCT "year") FROM aoi)"""))
def complete_bboxes(spark, sf_dir):
    return sc.complete_bboxes(derived.observations(spark, sf_dir), _aoi(spark))


def _stored_observations(spark, sf_dir) -> str:
    root = shared_folder(spark, "observations")
    sinks.append_observations(derived.observations(spark, sf_dir), root, ["bbox", "year"])
    return root


@query("scan_partition", o.with_(o.OBS, select="""
SELECT * FROM obs WHERE bbox = '410000,1130000,430000,1160000' AND "year" = 1997"""))
def scan_partition(spark, sf_dir):
    stored = tables.read_observations(spark, _stored_observations(spark, sf_dir))
    return tables.scan_partition(stored, "410000,1130000,430000,1160000", 1997)


@query("split_by_year", o.with_(o.OBS, select="""
SELECT CASE WHEN "year" IN (1995, 1996, 1997, 1998) THEN 'train' WHEN "year" IN (1999, 2000) THEN 'val' ELSE 'test' END AS split,
  "year", count(*) AS images FROM obs GROUP BY ALL"""))
def split_by_year(spark, sf_dir):
    split = tables.split_by_year(derived.observations(spark, sf_dir), {
        "train": [1995, 1996, 1997, 1998], "val": [1999, 2000], "test": [2001]})
    return split.groupBy("split", "year").agg(F.count(F.lit(1)).alias("images"))


@query("scan_pruned_tolerant", o.with_(o.OBS, select="""
SELECT CDL, count(*) AS "count", NULL::VARCHAR AS unread_file FROM obs GROUP BY CDL"""))
def scan_pruned_tolerant(spark, sf_dir):
    """Classes with their counts, and a row for each file that gave none."""
    classes, unread = tables.scan_class_column(spark, _stored_observations(spark, sf_dir))
    return classes.groupBy("CDL").count().withColumn("unread_file", F.lit(None).cast("string")).unionByName(
        unread.withColumnRenamed("path", "unread_file"), allowMissingColumns=True)


@query("partition_inventory", o.with_(o.OBS, select="""
SELECT bbox, "year", tile, count(DISTINCT scene_date) AS n,
  string_agg(DISTINCT scene_date::VARCHAR, ',' ORDER BY scene_date::VARCHAR) AS scene_dates FROM obs GROUP BY ALL"""))
def partition_inventory(spark, sf_dir):
    inv = tables.partition_inventory(derived.observations(spark, sf_dir))
    return inv.select("bbox", "year", "tile", F.size("scene_dates").cast("bigint").alias("n"),
                      F.array_join(F.col("scene_dates").cast("array<string>"), ",").alias("scene_dates"))


@query("distinct_partitions", o.with_(o.OBS, select='SELECT DISTINCT bbox, "year" FROM obs'))
def distinct_partitions(spark, sf_dir):
    return tables.distinct_partitions(derived.observations(spark, sf_dir))


@query("sorted_years", o.with_(o.OBS, select="""
SELECT string_agg(DISTINCT "year"::VARCHAR, ',' ORDER BY "year"::VARCHAR) AS years FROM obs"""))
def sorted_years(spark, sf_dir):
    y = tables.sorted_years(derived.observations(spark, sf_dir))
    return y.select(F.array_join(F.col("values").cast("array<string>"), ",").alias("years"))


@query("tag_constants", o.with_(o.OBS, select="""
SELECT 'zone' AS bbox, 1999 AS "year", CDL, count(*) AS samples FROM obs GROUP BY CDL"""))
def tag_constants(spark, sf_dir):
    plain = derived.observations(spark, sf_dir).drop("bbox", "year")
    return tables.tag_constants(plain, "zone", 1999).groupBy("bbox", "year", "CDL").agg(
        F.count(F.lit(1)).alias("samples"))


@query("point_lookup", o.with_(o.OBS, select=f"""
SELECT scene_date, tile, red, nir, round(CASE WHEN nir + red <> 0 THEN (nir - red)::DOUBLE/(nir + red) END, 6) AS ndvi
FROM obs WHERE lon = -90.6e0 + 3*0.0003e0 AND lat = 35.5e0 AND CDL = 'Cotton' AND "year" = 1998"""))
def point_lookup(spark, sf_dir):
    from fieldtide.operators import series as sr

    hit = derived.observations(spark, sf_dir).where(
        (F.col("lon") == -90.6 + 3 * 0.0003) & (F.col("lat") == 35.5)
        & (F.col("CDL") == "Cotton") & (F.col("year") == 1998))
    return sr.ndvi_series(hit).select(
        "scene_date", "tile", "red", "nir", F.round("ndvi", 6).alias("ndvi"))


# --- AOI configuration joined with the data -------------------------------------

@query("aoi_dim", o.with_(o.OBS, o.AOI, select="""
SELECT name, a.bbox, a."year", count(o.bbox) AS samples FROM aoi a LEFT JOIN obs o ON o.bbox = a.bbox AND o."year" = a."year"
GROUP BY ALL"""))
def aoi_dim(spark, sf_dir):
    counts = derived.observations(spark, sf_dir).groupBy("bbox", "year").count()
    return _aoi(spark).join(counts, ["bbox", "year"], "left").select(
        "name", "bbox", "year", F.coalesce("count", F.lit(0)).alias("samples"))


@query("aoi_first", o.with_(o.OBS, o.AOI, select="""
SELECT name, a.bbox, a."year", (SELECT count(*) FROM obs o WHERE o.bbox = a.bbox AND o."year" = a."year") AS samples
FROM (SELECT * FROM aoi ORDER BY line, "year" LIMIT 1) a"""))
def aoi_first(spark, sf_dir):
    counts = derived.observations(spark, sf_dir).groupBy("bbox", "year").count()
    return aoi.first_aoi(_aoi(spark)).join(counts, ["bbox", "year"], "left").select(
        "name", "bbox", "year", F.coalesce("count", F.lit(0)).alias("samples"))


@query("bbox_year_grid", o.with_(o.OBS, o.AOI, select="""
SELECT b.bbox, y."year", (SELECT count(*) FROM obs o WHERE o.bbox = b.bbox AND o."year" = y."year") AS samples
FROM (SELECT DISTINCT bbox FROM aoi) b, (SELECT DISTINCT "year" FROM aoi) y"""))
def bbox_year_grid(spark, sf_dir):
    counts = derived.observations(spark, sf_dir).groupBy("bbox", "year").count()
    return aoi.bbox_year_grid(_aoi(spark)).join(counts, ["bbox", "year"], "left").select(
        "bbox", "year", F.coalesce("count", F.lit(0)).alias("samples"))


@query("parse_bbox", o.with_(o.OBS, select="""
SELECT bbox, split_part(bbox, ',', 1)::BIGINT AS min_x, split_part(bbox, ',', 2)::BIGINT AS min_y,
  split_part(bbox, ',', 3)::BIGINT AS max_x, split_part(bbox, ',', 4)::BIGINT AS max_y, count(*) AS n FROM obs GROUP BY ALL"""))
def parse_bbox(spark, sf_dir):
    b = geo.parse_bbox(F.col("bbox"))
    return derived.observations(spark, sf_dir).groupBy("bbox").agg(
        F.count(F.lit(1)).alias("n")).select(
        "bbox", *[b[i].alias(n) for i, n in enumerate(("min_x", "min_y", "max_x", "max_y"))], "n")


@query("format_bbox", o.with_(o.OBS, select="""
SELECT concat_ws(',', trunc(min(lon*1000))::BIGINT::VARCHAR, trunc(min(lat*1000))::BIGINT::VARCHAR,
  trunc(max(lon*1000))::BIGINT::VARCHAR, trunc(max(lat*1000))::BIGINT::VARCHAR) AS bbox FROM obs"""))
def format_bbox(spark, sf_dir):
    return sc.bounds_text(
        derived.observations(spark, sf_dir), F.col("lon") * 1000, F.col("lat") * 1000)


@query("split_list_arg", o.with_(o.OBS, select="""
SELECT item, count(*) AS n FROM (SELECT unnest(string_split(bbox, ',')) AS item FROM obs
  UNION ALL SELECT unnest(string_split(CDL || '|' || tile, '|')) FROM obs) GROUP BY item"""))
def split_list_arg(spark, sf_dir):
    obs = derived.observations(spark, sf_dir)
    both = F.array(F.col("bbox"), F.concat_ws("|", "CDL", "tile"))
    return obs.select(F.explode(both).alias("arg")).select(
        F.explode(text.split_list(F.col("arg"))).alias("item")).groupBy("item").agg(
        F.count(F.lit(1)).alias("n"))


# --- outcome report ---------------------------------------------------------------

#: Catalog entry per scene of the observations with gaps; coverage from its key.
_COVER = "(day(scene_date)*7 + \"year\") % 100"


@query("scene_run_report", o.with_(o.OBS, o.GAPS, f"""
facts AS (SELECT bbox, "year", tile, scene_date, ({_DEAD}) AS dead,
  count(*) FILTER (scl NOT IN (0,1,7,8,9,11)) AS usable,
  count(*) FILTER (scl NOT IN (0,1,7,8,9,11) AND {' AND '.join(f'{a} IS NOT NULL' for a in ASSETS)}) AS n
  FROM gaps GROUP BY ALL)""", select=f"""
SELECT CASE WHEN day(scene_date) > 25 THEN 'stored' WHEN {_COVER} <= 30 THEN 'low_coverage' WHEN dead > 6.5 THEN 'failed_assets'
  WHEN usable = 0 THEN 'all_masked' WHEN n = 0 THEN 'all_incomplete' ELSE 'written' END AS outcome,
  count(*) AS scenes, sum(n)::BIGINT AS "rows" FROM facts GROUP BY 1"""))
def scene_run_report(spark, sf_dir):
    obs = derived.observation_gaps(spark, sf_dir)
    catalog = obs.select(*SCENE).distinct().withColumn(
        "coverage", (F.day("scene_date") * 7 + F.col("year")) % 100)
    stored = obs.where(F.day("scene_date") > 25)
    return sc.scene_outcomes(catalog, stored, obs).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("scenes"), F.sum("rows").cast("bigint").alias("rows"))
