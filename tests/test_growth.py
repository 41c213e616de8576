"""Work that grows with the input and no faster: exchanges, repeated points, method sizes."""

from pyspark.sql import functions as F

from fieldtide.constants import SERIES
from fieldtide.functions import geo, vectors
from fieldtide.operators import features as ft, quality, raster as rs, series as sr, windows as wn
from fieldtide.operators.windows import WindowSpec
from fieldtide.plans import catalog
from fieldtide.plans.series_queries import masked
from fieldtide.sources import derived
from tests.test_plans import exchanges, plan


def test_assets_meet_in_one_exchange(spark, sf_dir):
    """A pivot shuffled every sample, thirteen rows for each observation."""
    keys = ["CDL", "lon", "lat", "bbox", "year", "tile", "scene_date"]
    samples = derived.asset_samples(spark, sf_dir)
    assert exchanges(quality.assemble_assets(samples, keys)) == 1


def test_points_are_not_dealt_by_tile(spark):
    """All points of a tile lay in one task, and each was projected for every raster."""
    points = spark.range(10).selectExpr("if(id < 9, 'a', 'b') tile", "-90.6D lon", "35.5D lat")
    rasters = spark.createDataFrame(
        [(t, f"{t}{k}", 32615, 0.0, 4e6, 10.0) for t in "ab" for k in range(3)],
        "tile string, raster string, epsg int, origin_x double, origin_y double, cell double")
    cells = spark.createDataFrame([("a0", 1, 1, 5)], "raster string, row long, col long, code int")
    hit = rs.sample_rasters(points, rasters, cells, ["tile"])
    assert "BroadcastHashJoin [tile" in plan(hit) and hit.count() == 30
    x, y = geo.lonlat_to_crs(F.col("lon"), F.col("lat"), F.lit(32615))
    # three in each of x and y
    assert plan(points.select(x.alias("x"), y.alias("y"))).lower().count("atanh(") <= 6


def test_equal_points_are_sampled_once(spark):
    points = spark.range(12).selectExpr("id % 3 x", "0 y").union(spark.sql("select null, 0"))
    got = {r.x: r.points for r in rs.counted_points(points).collect()}
    assert got == {0: 4, 1: 4, 2: 4, None: 1}
    query = plan(catalog.QUERIES["sample_rasters_at_points"](spark, "/root/testdata/sf0.001"))
    # points are counted before they are joined
    assert "HashAggregate" in query[query.index("SortMergeJoin") if "SortMergeJoin" in query else query.index("HashJoin"):]


def test_stages_are_fused_as_far_as_they_are_compiled(spark, sf_dir):
    catalog.QUERIES["clean_numeric"](spark, sf_dir)
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_swept_examples_are_those_of_the_expressions(spark, sf_dir):
    """Windows cut in Arrow batches: the same rows as windows cut by expressions, bit for bit."""
    whole = sr.window_series(masked(spark, sf_dir))
    days = [-15, 0, 45, 200, 400]
    stats = ft.norm_stats(ft.pick_rows(wn.cut(whole.withColumn("start_day", F.lit(0)), WindowSpec()), *SERIES))
    for given in (None, stats):
        want = ft.make_examples(
            wn.sweep_start_days(whole, days), WindowSpec(), given, start_day=F.col("start_day"), keep=SERIES)
        got = ft.swept_examples(whole, WindowSpec(), days, SERIES, given).select(*want.columns)
        assert dict(got.dtypes) == dict(want.dtypes)
        rows = [sorted(map(str, df.collect())) for df in (want, got)]
        assert rows[0] == rows[1] and len(rows[0]) == len(days) * whole.count()


def test_derived_arrays_are_exploded_without_computing_them_again(spark):
    wide = spark.range(3).select("id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda x: F.sin(x + F.col("id"))).alias("v"))
    rows = wide.select("id", F.posexplode(vectors.held("v")).alias("i", "x"))
    assert plan(rows).split("== Physical")[0].lower().count("sin(") == 1 and rows.count() == 12
