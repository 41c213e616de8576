"""Raw features keep whole numbers of any size, and mixed examples are compared feature by feature."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldtide.constants import BANDS
from fieldtide.operators import augment, features as ft, series as sr, windows as wn
from fieldtide.operators.windows import WindowSpec

#: nir + 6 red - 7.5 blue + 1 is zero, so the enhanced index is (nir - red) * 250 / 1e-6, truncated.
LIT = {"blue": 1000, "red": 1, "nir": 7493}


@pytest.fixture(scope="module")
def obs(spark):
    bands = [F.lit(LIT.get(b, 7)).alias(b) for b in BANDS]
    return spark.range(3).select(
        F.lit("0,0,1,1").alias("bbox"), F.lit(1999).alias("year"), F.lit(-90.5).alias("lon"), F.lit(35.5).alias("lat"),
        F.lit("Corn").alias("CDL"), F.lit(4).alias("scl"), *bands, F.lit("15SYV_1").alias("tile"),
        F.expr("date_add(date'1999-03-01', cast(id * 40 as int))").alias("scene_date"))


def examples(obs):
    spec = WindowSpec()
    series = sr.window_series(obs)
    yield ft.make_examples(series, spec)
    yield ft.make_examples(wn.cut_random(obs, spec), spec)
    yield ft.make_examples(wn.sweep_start_days(series, [0]), spec, start_day=F.col("start_day"))
    one = ft.make_examples(series, spec, start_day=F.lit(0))
    yield augment.time_roll(one, F.lit(1), spec.size, 16)


def test_large_index_values_are_exact(obs):
    from fieldtide.functions import spectral

    want = obs.select(spectral.evi_index(*(F.col(c).cast("double") for c in ("nir", "red", "blue")))).first()[0]
    assert want > 1 << 40 and want % (1 << 20)  # a float has 24 bits
    for number, ex in enumerate(examples(obs)):
        found = {v for v in ex.first().features if v > 1e6}
        assert found == {float(want)}, number


def test_mixup_gives_every_feature(spark, sf_dir):
    mixed = entry.queries()["mixup"](spark, sf_dir)
    per = mixed.groupBy("bbox", "year", "lon", "lat", "CDL").agg(F.countDistinct("i").alias("n"))
    assert {r.n for r in per.select("n").distinct().collect()} == {400}
