"""Windows, buckets and labels on hand-made series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldtide.constants import BANDS, SERIES
from fieldtide.operators import labels, series as sr, windows as wn
from fieldtide.operators.windows import WindowSpec

START = dt.date(2021, 1, 1)


def obs(spark, days, scls=None, cdl="Corn", tiles=None, lon=1.0):
    rows = []
    for i, d in enumerate(days):
        bands = {b: 100 * (k + 1) + i for k, b in enumerate(BANDS)}
        rows.append(dict(
            CDL=cdl, lon=lon, lat=2.0, scl=scls[i] if scls else 4, bbox="z", year=2021,
            tile=tiles[i] if tiles else "T", scene_date=START + dt.timedelta(days=d), **bands))
    names = ["CDL", "lon", "lat", "scl", *BANDS, "bbox", "year", "tile", "scene_date"]
    kinds = {"CDL": "string", "lon": "double", "lat": "double", "bbox": "string",
             "tile": "string", "scene_date": "date"}
    schema = ", ".join(f"{n} {kinds.get(n, 'int')}" for n in names)
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def cut(spark, days, spec, start, capped=False, **kw):
    s = sr.window_series(obs(spark, days, **kw)).withColumn("start_day", F.lit(start))
    return wn.cut(s, spec, capped=capped)


def test_worked_example(spark):
    # Day 0 anchors the series, so the listed days are days since the first image.
    days = [0, 120, 135, 153, 156, 162, 165, 178, 200]
    spec = WindowSpec(30, 10, 2)
    df = cut(spark, days, spec, 150)
    row = df.select(
        F.transform("picks", lambda p: p["bucket"]).alias("b"),
        F.transform("picks", lambda p: p["day"]).alias("d")).first()
    assert row.b == [0, 1, 2]
    assert row.d == [0, 12, 25]
    kept = wn.slice_window(F.col("images"), F.lit(150), F.lit(30))
    assert sr.window_series(obs(spark, days)).select(
        F.transform(kept, lambda o: o["day"])).first()[0] == [153, 156, 162, 165, 178]


@pytest.mark.parametrize("last, strategy, want", [
    (200, "early_season", 0), (200, "mid_season", 40), (200, "late_season", 80),
    (61, "mid_season", -30), (61, "late_season", 0), (61, "deterministic", 0),
    (61, "random", 0),
])
def test_start_strategies(spark, last, strategy, want):
    s = sr.window_series(obs(spark, [0, last]))
    assert s.select(wn.window_start(strategy)).first()[0] == want


def test_unknown_strategy_is_deterministic(spark):
    s = sr.window_series(obs(spark, [0, 10, 300]))
    a, b = s.select(wn.window_start("no such"), wn.window_start("deterministic")).first()
    assert a == b and 0 <= a < 180


def test_empty_window_keeps_the_crop_label(spark):
    df = labels.label_windows(cut(spark, [0, 300], WindowSpec(), 100), 2)
    row = df.select("picks", "vegetation", "label").first()
    assert row.picks == [] and row.vegetation is None and row.label == 5


def test_one_image(spark):
    row = cut(spark, [0], WindowSpec(), 0).select("picks", "num_images", "last_day").first()
    assert len(row.picks) == 1 and row.num_images == 1 and row.last_day == 0


def test_negative_start_keeps_the_first_days(spark):
    df = cut(spark, [0, 40], WindowSpec(), -30)
    assert [p.day for p in df.first().picks] == [0, 40]


def test_both_window_ends_are_inside(spark):
    df = cut(spark, [0, 30, 150, 151], WindowSpec(), 30)
    assert [p.day for p in df.first().picks] == [0, 120]


def test_overlapping_tiles_break_ties_by_tile(spark):
    df = cut(spark, [0, 0], WindowSpec(), 0, scls=[5, 4], tiles=["B", "A"])
    assert [p.scl for p in df.first().picks] == [4]


def test_cap_comes_before_buckets(spark):
    spec = WindowSpec(10, 5, 2)  # three images at most
    df = cut(spark, [0, 1, 2, 9], spec, 0, capped=True)
    assert [p.bucket for p in df.first().picks] == [0]
    df = cut(spark, [0, 1, 2, 9], spec, 0)
    assert [p.bucket for p in df.first().picks] == [0, 1]


@pytest.mark.parametrize("scls, frames, label", [
    ([4, 5, 5], 2, 2), ([4, 5, 5], 3, 5), ([5, 5, 4], 1, 5), ([0, 0, 0], 3, 5), ([4, 0, 0], 1, 5),
])
def test_vegetation_in_the_last_frames(spark, scls, frames, label):
    df = labels.label_windows(cut(spark, [0, 20, 40], WindowSpec(), 0, scls=scls), frames)
    assert df.first().label == label


@pytest.mark.parametrize("cdl, want", [
    ("Soybeans", 3), ("Cotton", 6), ("Alfalfa", 1), ("Open Water", 0)])
def test_base_labels(spark, cdl, want):
    df = spark.createDataFrame([(cdl,)], "CDL string")
    assert df.select(labels.base_label(F.col("CDL"))).first()[0] == want


def test_series_key_has_no_other_columns():
    assert SERIES == ["bbox", "year", "lon", "lat", "CDL"]
