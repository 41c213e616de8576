"""A series over several rows gives the results of a series in one row."""

import pytest
from pyspark.sql import functions as F

from fieldtide.constants import SERIES
from fieldtide.operators import series as sr, windows as wn
from fieldtide.operators.windows import WindowSpec
from fieldtide.plans import catalog
from fieldtide.plans.series_queries import masked
from tests.oracle_check import compare

ROW_LEVEL = ["sort_series", "image_map", "window_slice", "cap_images", "cap_images_random",
             "bucketize", "valid_series", "unpack_series"]


@pytest.fixture
def short_rows(monkeypatch):
    monkeypatch.setattr(sr, "ROW_IMAGES", 7)


@pytest.mark.parametrize("name", ROW_LEVEL)
def test_results_do_not_depend_on_rows(short_rows, name, spark, duck, sf_dir):
    assert compare(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLES[name]) is None


def test_rows_carry_the_whole_series(short_rows, spark, sf_dir):
    parts = sr.build_series(masked(spark, sf_dir))
    whole = sr.build_series(masked(spark, sf_dir), 10**6)
    assert parts.select(F.max("part")).first()[0] > 3
    assert parts.select(F.max(F.size("images"))).first()[0] == 7
    assert whole.select(F.max("part")).first()[0] == 0
    facts = lambda s: s.select(*SERIES, *sr.FACTS).distinct()
    assert facts(parts).exceptAll(facts(whole)).isEmpty()
    assert facts(whole).exceptAll(facts(parts)).isEmpty()


def test_packed_rows_come_back(short_rows, spark, sf_dir):
    parts = sr.build_series(masked(spark, sf_dir))
    back = sr.unpack_series(sr.pack_series(parts)).select(*parts.columns)
    assert parts.exceptAll(back).isEmpty() and back.exceptAll(parts).isEmpty()
    bare = sr.pack_series(sr.build_series(masked(spark, sf_dir), 10**6)).drop(*sr.PACKED_FACTS)
    whole = sr.build_series(masked(spark, sf_dir), 10**6)
    back = sr.unpack_series(bare).select(*whole.columns)
    assert whole.exceptAll(back).isEmpty()


def test_plans_are_lazy_with_one_exchange(spark, sf_dir):
    for build in (sr.build_series, sr.window_series, lambda o: wn.cut_random(o, WindowSpec())):
        obs = masked(spark, sf_dir)
        before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
        df = build(obs)
        assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange") == 1 and "Python" not in text


def test_caps_add_no_exchange(spark, sf_dir):
    s = sr.build_series(masked(spark, sf_dir))
    for df in (wn.capped_images(s, F.lit(0), F.lit(180), 25), wn.capped_images(s, F.lit(0), F.lit(180), 25, 42),
               wn.bucketed_images(s, F.lit(0), WindowSpec())):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
