"""Footprints against areas: separating axes, cells of the grid, odd polygons; merged sketches."""

import random

import pytest
from pyspark.sql import functions as F

from fieldtide.functions import geo
from fieldtide.operators import classes as cl
from fieldtide.operators import scenes as sc
from fieldtide.sources import derived, sinks

POLYGON = "array<struct<x double, y double>>"
SCENES = f"seq long, datetime timestamp_ntz, collection string, footprint {POLYGON}, area string"


def _box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def _diamond(x, y, r):
    return [(x - r, y), (x, y - r), (x + r, y), (x, y + r)]


@pytest.mark.parametrize("a,b,meets", [
    (_box(0, 0, 1, 1), _box(1, 1, 1, 1), True),  # a corner touches
    (_box(0, 0, 1, 1), _box(1.001, 0, 1, 1), False),
    (_diamond(0, 0, 1), _box(0.8, 0.8, 1, 1), False),  # the boxes meet, the polygons do not
    (_diamond(0, 0, 1), _box(0.5, 0.5, 1, 1), True),  # an edge through the corner
    (_box(0, 0, 9, 9), _diamond(4, 4, 1), True),  # inside
    (_box(0, 0, 1, 1) + [(0, 0)], _diamond(3, 0, 1), False),  # closed ring
    ([(2, 2)], _box(0, 0, 3, 3), True), ([], _box(0, 0, 1, 1), None), (None, _box(0, 0, 1, 1), None)])
def test_convex_overlap(spark, a, b, meets):
    df = spark.createDataFrame([(a and [tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in b])], f"a {POLYGON}, b {POLYGON}")
    got = df.select(geo.convex_overlap(F.col("a"), F.col("b")), geo.convex_overlap(F.col("b"), F.col("a"))).first()
    assert tuple(got) == (meets, meets)


def _crosses(a, b):
    """Clip a by the edges of b (both counter-clockwise); something is left if they overlap."""
    for (x0, y0), (x1, y1) in zip(b, b[1:] + b[:1]):
        side = [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x, y in a]
        out = []
        for i, (p, q) in enumerate(zip(a, a[1:] + a[:1])):
            s, t = side[i], side[(i + 1) % len(a)]
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        a = out
        if not a:
            return False
    return True


@pytest.mark.parametrize("cell", [0.3, 1.0, 50.0])
def test_search_equals_clipping_of_all_pairs(spark, cell):
    draw = random.Random(3)
    shape = lambda: (_diamond if draw.random() < 0.5 else lambda x, y, r: _box(x, y, r, 2 * r))(
        draw.uniform(-3, 3), draw.uniform(-3, 3), draw.uniform(0.05, 0.9))
    day = "2024-01-0{}T00:00:00"
    import datetime as dt

    rows = [(i, dt.datetime.fromisoformat(day.format(i % 3 + 1)), ("l2a", "l1c")[i % 5 == 0], shape(), "old") for i in range(150)]
    rows += [(900, rows[0][1], "l2a", None, None), (901, rows[0][1], "l2a", [], None), (902, None, None, _box(0.0, 0.0, 1.0, 1.0), None)]
    places = [(i, shape()) for i in range(40)] + [(None, _box(-3.0, -3.0, 6.0, 6.0)), (50, []), (51, None)]
    areas = spark.createDataFrame(places, f"area long, polygon {POLYGON}")
    scenes = spark.createDataFrame(rows, SCENES)
    got = sc.footprint_search(scenes, areas, "2024-01-01 00:00:00", "2024-01-02 00:00:00", ["l2a"], cell)
    assert got.columns == ["area", "seq", "datetime", "collection", "footprint"]
    want = sorted((i, r[0]) for i, p in places[:40] for r in rows[:150]
                  if r[2] == "l2a" and r[0] % 3 < 2 and _crosses(r[3], p))
    assert sorted((r.area, r.seq) for r in got.collect()) == want and len(want) > 100
    assert sc.footprint_search(scenes, areas.limit(0), "2024-01-01", "2024-01-02", ["l2a"], cell).count() == 0


def test_sketches_merge_and_read_new_partitions_only(spark, tmp_path):
    obs = derived.observations(spark, "/root/testdata/sf0.001").withColumn("nir", F.lit(None).cast("int"))
    stored, root = f"{tmp_path}/obs", f"{tmp_path}/sketches"
    old, new = obs.where("year < 1996"), obs.where("year >= 1996")
    sinks.append_observations(old, stored, ["bbox", "year"])
    assert cl.refresh_sketches(spark, stored, root) == old.select("bbox", "year").distinct().count() > 0
    for path in tmp_path.glob("obs/*/*/*.parquet"):  # what is done is not opened again
        path.write_bytes(b"broken")
    sinks.append_observations(new, stored, ["bbox", "year"])
    assert cl.refresh_sketches(spark, stored, root) == new.select("bbox", "year").distinct().count() > 0
    assert cl.refresh_sketches(spark, stored, root) == 0
    got = {r.asset: r for r in cl.sketch_profile(spark.read.parquet(root)).collect()}
    for r in cl.asset_profile(obs).collect():
        mine = got[r.asset]
        assert (mine.min, mine.max) == (r.min, r.max)
        assert abs(mine.distinct_values - r.distinct_values) <= 0.05 * r.distinct_values
    assert got["nir"].distinct_values == 0
