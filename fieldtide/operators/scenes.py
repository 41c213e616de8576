"""Scene catalog: search, versions, coverage, and what is still to do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtide.constants import ASSETS, COVERAGE_MIN, SCENE, SCL_DROP
from fieldtide.functions import geo, text


def catalog_search(
    scenes: DataFrame, bounds: Sequence[float], first: str, last: str,
) -> DataFrame:
    """Scenes whose footprint meets the bounds in a closed time range."""
    min_x, min_y, max_x, max_y = map(float, bounds)
    return scenes.where(
        (F.col("min_lon") <= max_x) & (F.col("max_lon") >= min_x)
        & (F.col("min_lat") <= max_y) & (F.col("max_lat") >= min_y)
        & F.col("datetime").between(F.lit(first).cast("timestamp_ntz"),
                                    F.lit(last).cast("timestamp_ntz")))


def footprint_search(
    scenes: DataFrame, areas: DataFrame, first: str, last: str, collections: Sequence[str],
    cell: float = 0.25,
) -> DataFrame:
    """Scenes of the collections and the closed time range whose footprint meets an area.

    areas holds (area, polygon), scenes a `footprint`: convex polygons as arrays of
    struct(x, y). Both sides are dealt over the cells of a coarse grid that their boxes touch and
    meet by equality of cells, so areas are not compared with all scenes; a pair is looked at in
    one of its common cells only. Boxes come first, the exact test after them. Cells should be
    about as large as a footprint. Null or empty polygons and a null area id meet nothing.
    """
    def dealt(df: DataFrame, polygon: str, mark: str) -> DataFrame:
        names = [f"{mark}{k}" for k in ("x0", "y0", "x1", "y1")]
        boxed = df.where(F.size(polygon) > 0).withColumns(dict(zip(names, geo.polygon_bounds(F.col(polygon)))))
        at = {n: F.floor(F.col(n) / cell) for n in names}
        return (
            boxed.withColumn("_cx", F.explode(F.sequence(at[names[0]], at[names[2]])))
            .withColumn("_cy", F.explode(F.sequence(at[names[1]], at[names[3]])))
        )

    wanted = scenes.where(
        F.col("collection").isin(list(collections))
        & F.col("datetime").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))
    left = dealt(areas.where("area is not null").select(
        F.col("area").alias("_area"), F.col("polygon").alias("_polygon")), "_polygon", "_a")
    right = dealt(wanted.withColumn("_footprint", F.col("footprint")), "_footprint", "_s")
    common = [F.floor(F.greatest(f"_a{k}", f"_s{k}") / cell) for k in ("x0", "y0")]
    return (
        right.join(left, ["_cx", "_cy"])
        .where((F.col("_cx") == common[0]) & (F.col("_cy") == common[1]))
        .where("_ax0 <= _sx1 and _ax1 >= _sx0 and _ay0 <= _sy1 and _ay1 >= _sy0")
        .where(geo.convex_overlap(F.col("_footprint"), F.col("_polygon")))
        .select(F.col("_area").alias("area"), *[F.col(c) for c in scenes.columns if c != "area"])
    )


def parse_scene_id(scenes: DataFrame) -> DataFrame:
    """Add base id, grid square, version and tile key."""
    sid = F.col("id")
    return scenes.select(
        "*", text.scene_base(sid).alias("base"), text.scene_grid(sid).alias("grid"),
        text.scene_version(sid).alias("version"), text.scene_tile(sid).alias("tile"))


def latest_scene_version(scenes: DataFrame) -> DataFrame:
    """The highest version per base id; the earliest entry wins ties.

    An aggregate keeps one candidate per base and task, so a base with very many
    entries is reduced before the shuffle.
    """
    row = F.struct(*scenes.columns)
    rank = F.struct(text.scene_version(F.col("id")).alias("v"), (-F.col("seq")).alias("s"))
    return (
        scenes.groupBy(text.scene_base(F.col("id")).alias("base"))
        .agg(F.max_by(row, rank).alias("best")).select("base", "best.*")
    )


def one_tile_scenes(scenes: DataFrame, seed: int = 42) -> DataFrame:
    """Scenes of one grid square, chosen by the smallest seeded hash of its name."""
    grid = text.scene_grid(F.col("id"))
    chosen = scenes.select(grid.alias("grid")).distinct().agg(
        F.min_by("grid", F.struct(text.seeded_hash(F.col("grid"), seed=seed).alias("h"), "grid"))
        .alias("grid")).scalar()
    return scenes.where(grid == chosen)


def scene_coverage(scenes: DataFrame, minimum: float = COVERAGE_MIN) -> DataFrame:
    """Scenes with enough usable area, their coverage and the properties they lack."""
    doc = F.col("properties")
    return (
        scenes.withColumn("coverage", text.coverage(doc))
        .withColumn("missing", text.missing_keys(doc))
        .where(F.col("coverage") > minimum)
    )


def skip_existing(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of todo whose key is not done yet.

    Done keys are made distinct first; how the sides meet is left to adaptive
    execution, which splits skewed keys and broadcasts only a side it measured.
    """
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def complete_bboxes(stored: DataFrame, configured: DataFrame) -> DataFrame:
    """Bboxes that hold every configured year.

    A division by counting: distinct (bbox, configured year) pairs per bbox
    against the number of configured years.
    """
    years = configured.select("year").distinct()
    need = years.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        stored.select("bbox", "year").distinct().join(years, "year", "left_semi")
        .groupBy("bbox").agg(F.count(F.lit(1)).alias("years"))
        .where(F.col("years") == need)
    )


def scene_outcomes(
    scenes: DataFrame, stored: DataFrame, obs: DataFrame, keys: Sequence[str] = SCENE,
) -> DataFrame:
    """What happens to each scene: the first rule that applies decides.

    scenes has the scene keys and a `coverage`; stored the keys already written;
    obs the sampled assets. Outcomes: stored, low_coverage, failed_assets,
    all_masked, all_incomplete, written.
    """
    usable = ~F.col("scl").isin(SCL_DROP)
    complete = F.col(ASSETS[0]).isNotNull()
    for a in ASSETS[1:]:
        complete = complete & F.col(a).isNotNull()
    dead = sum((F.when(F.count(a) == 0, 1).otherwise(0) for a in ASSETS), F.lit(0))
    facts = obs.groupBy(*keys).agg(
        dead.alias("dead"), F.count_if(usable).alias("usable"),
        F.count_if(usable & complete).alias("rows"))
    done = stored.select(*keys).distinct().withColumn("done", F.lit(True))
    outcome = (
        F.when(F.col("done"), "stored")
        .when(F.col("coverage") <= COVERAGE_MIN, "low_coverage")
        .when(F.coalesce("dead", F.lit(len(ASSETS))) > len(ASSETS) * 0.5, "failed_assets")
        .when(F.col("usable") == 0, "all_masked")
        .when(F.col("rows") == 0, "all_incomplete")
        .otherwise("written"))
    return (
        scenes.join(done, list(keys), "left").join(facts, list(keys), "left")
        .select(*keys, outcome.alias("outcome"), F.coalesce("rows", F.lit(0)).alias("rows"))
    )


def bounds_text(points: DataFrame, x: Column, y: Column) -> DataFrame:
    """Total bounds of points as bbox text."""
    from fieldtide.functions.geo import format_bbox

    return points.agg(F.min(x).alias("a"), F.min(y).alias("b"), F.max(x).alias("c"),
                      F.max(y).alias("d")).select(
        format_bbox(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("bbox"))
