"""Domain tables derived from the star-schema and event tables.

Everything is column arithmetic over one scan, so the domain tables keep the
parallelism, the pushed filters and the pruned columns of their source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldtide import schemas
from fieldtide.constants import ASSETS, BANDS, COVERAGE_KEYS

#: Class name by supplier key modulo 16.
CLASS_BY_KEY = [
    "Soybeans", "Rice", "Corn", "Cotton", "Peanuts", "Winter Wheat", "Sorghum",
    "Oats", "Alfalfa", "Open Water", "Grass/Pasture", "Deciduous Forest",
    "Developed/Open Space", "Fallow/Idle Cropland", "Dbl Crop WinWht/Soybeans",
    "Background",
]
#: AOI configuration lines: a comment, a ", " separator and overlapping years.
AOI_LINES = [
    "# comment",
    "zone_a|390000,1100000,410000,1130000|1998",
    "zone_b|410000, 1130000, 430000, 1160000|1996,1997",
    "zone_c|430000,1160000,450000,1190000|1997,1999",
]
RASTER_COLS = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.SOURCES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], position: str) -> str:
    """SQL for an element of a constant list (folded to one literal)."""
    return f"get(array({', '.join(map(repr, values))}), cast({position} as int))"


def _class_name() -> str:
    return _pick(CLASS_BY_KEY, "l_suppkey % 16")


_LON = "-90.6D + (l_suppkey % 100) * 0.0003D"
_LAT = "35.5D + (l_suppkey div 100) * 0.0003D"
_SQUARES = [
    ",".join(map(str, (390000 + g * 20000, 1100000 + g * 30000,
                       410000 + g * 20000, 1130000 + g * 30000)))
    for g in range(4)
]
_TILES = [f"15SY{letter}_{i % 2}" for i, letter in enumerate("UVWXYZT", 1)]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation per line item: key, labels, mask layer and twelve bands."""
    return observations_of(table(spark, sf_dir, "lineitem"))


def observations_of(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        f"{_class_name()} as CDL",
        f"{_LON} as lon",
        f"{_LAT} as lat",
        "cast((l_orderkey + l_partkey * 5 + l_linenumber * 7) % 12 as int) as scl",
        *[f"cast((l_orderkey * {k + 7} + l_partkey * {k + 13} + l_linenumber * 101"
          f" + {(k + 1) * 997}) % 10000 as int) as {name}" for k, name in enumerate(BANDS)],
        f"{_pick(_SQUARES, 'l_suppkey % 4')} as bbox",
        "year(l_shipdate) as year",
        f"{_pick(_TILES, 'l_linenumber - 1')} as tile",
        "cast(l_shipdate as date) as scene_date",
    )


def observation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in which some scene days lost the tail of their assets."""
    lost = f"case day(scene_date) % 4 when 0 then 5 when 1 then 10 else {len(ASSETS)} end"
    return observations(spark, sf_dir).selectExpr(
        "CDL", "lon", "lat",
        *[f"cast(case when {lost} > {i} then {a} end as double) as {a}"
          for i, a in enumerate(ASSETS)],
        "bbox", "year", "tile", "scene_date",
    )


def asset_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the observations with gaps: one row per sampled asset."""
    wide = observation_gaps(spark, sf_dir)
    return wide.unpivot(
        ["CDL", "lon", "lat", "bbox", "year", "tile", "scene_date"],
        ASSETS, "asset", "value",
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalog, one entry per event: id, time, JSON properties and footprint."""
    return scenes_of(table(spark, sf_dir, "events"))


def scenes_of(events: DataFrame) -> DataFrame:
    lon, lat = "-91.0D + (user_id % 20) * 0.05D", "35.0D + (user_id % 10) * 0.05D"
    return events.selectExpr(
        "concat('S2A_15SY', substr('UVWXYZ', cast(user_id % 6 as int) + 1, 1), '_',"
        " date_format(ts, 'yyyyMMdd'), '_', event_id % 3, '_L2A') as id",
        "event_id as seq",
        "ts as datetime",
        # The one percentage the source carries arrives under its catalog name.
        f"replace(props, '\"k\"', '\"{COVERAGE_KEYS[0]}\"') as properties",
        "user_id",
        f"{lon} as min_lon", f"{lat} as min_lat",
        f"{lon} + 0.1D as max_lon", f"{lat} + 0.1D as max_lat",
    )


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalog of two collections with the tilted outline inside each box."""
    tilt = "(user_id % 5) * 0.01D"
    corners = [f"min_lon + {tilt}, 'y', max_lat", f"max_lon, 'y', max_lat - {tilt}",
               f"max_lon - {tilt}, 'y', min_lat", f"min_lon, 'y', min_lat + {tilt}"]
    return scenes(spark, sf_dir).selectExpr(
        "id", "seq", "datetime", "if(seq % 4 = 0, 'l1c', 'l2a') as collection",
        f"array({', '.join(f"named_struct('x', {c})" for c in corners)}) as footprint")


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle of interest for every nation."""
    x, y = "-91.0D + (n_nationkey % 5) * 0.2D", "35.0D + (n_nationkey div 5) * 0.1D"
    corners = [f"{x}, 'y', {y}", f"{x} + 0.07D, 'y', {y} + 0.02D", f"{x} + 0.01D, 'y', {y} + 0.06D"]
    nation = spark.read.schema("n_nationkey int").parquet(f"{sf_dir}/nation.parquet")
    return nation.selectExpr(
        "n_nationkey as area", f"array({', '.join(f"named_struct('x', {c})" for c in corners)}) as polygon")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label raster as a cell table."""
    return table(spark, sf_dir, "part").selectExpr(
        f"p_partkey div {RASTER_COLS} as row", f"p_partkey % {RASTER_COLS} as col",
        "cast(p_size % 12 as int) as code")


def legend(spark: SparkSession) -> DataFrame:
    """Code table of the label raster; codes 10 and 11 have no class name."""
    rows = [
        (i, CLASS_BY_KEY[i] if i < 10 else None, i * 20, 255 - i * 20, i * 7)
        for i in range(12)
    ]
    return spark.createDataFrame(
        rows, "Codes int, Class_Names string, ESRI_Red int, ESRI_Green int, ESRI_Blue int")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored table: true label and seven class probabilities per line item."""
    weights = [f"(1 + (h * {i + 3} + {i * i * 11}) % 97)" for i in range(7)]
    total = " + ".join(weights)
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7 as h",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return rows.selectExpr(
        "h", "l_orderkey", "l_partkey", "l_suppkey as pixel_id",
        f"{_LON} as longitude", f"{_LAT} as latitude", f"{_class_name()} as raw_cdl",
        "l_linenumber * 30 - 15 as start_day",
        "cast((l_suppkey % 7 + if(h % 5 = 0, 1, 0)) % 7 as int) as true_label",
        "array(" + ", ".join(
            f"cast({w} as double) / cast({total} as double)" for w in weights) + ") as probs",
    )


def aoi_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in AOI_LINES], "value string")
