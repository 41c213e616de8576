"""Plan shapes: one shuffle, no Python, pruned scans."""

import pytest
from pyspark.sql import functions as F

from fieldtide import schemas
from fieldtide.operators import features as ft, labels, series as sr, windows as wn
from fieldtide.operators.windows import WindowSpec
from fieldtide.plans.series_queries import masked
from fieldtide.session import shared_folder
from fieldtide.sources import sinks, tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def series(spark, sf_dir):
    return sr.window_series(masked(spark, sf_dir))


def test_series_take_one_shuffle(series):
    assert exchanges(series) == 1
    assert "Python" not in plan(series)


def test_sweeps_add_no_shuffle(series):
    cut = wn.cut(wn.sweep_start_days(series), WindowSpec())
    assert exchanges(labels.label_windows(cut, 2)) == 1
    swept = labels.label_windows(wn.cut(wn.sweep_configs(series), capped=True),
                                 F.col("frames_to_check"))
    assert exchanges(swept) == 1
    assert "Join" not in plan(swept)


def test_examples_stay_in_the_jvm(series):
    ex = ft.make_examples(series, WindowSpec(), start_day=F.lit(0))
    assert exchanges(ex) == 1 and "Python" not in plan(ex)


def test_partition_scan_is_pruned(spark, sf_dir):
    root = shared_folder(spark, "pruned")
    sinks.append_observations(masked(spark, sf_dir), root, ["bbox", "year"])
    one = tables.scan_partition(
        tables.read_observations(spark, root), "410000,1130000,430000,1160000", 1997)
    text = plan(one.select("CDL", "nir"))
    assert "PartitionFilters: [isnotnull(bbox" in text
    assert "ReadSchema: struct<CDL:string,nir:int>" in text
    assert one.count() > 0


def test_class_scan_reads_one_column(spark, sf_dir):
    root = shared_folder(spark, "classes")
    sinks.append_observations(masked(spark, sf_dir), root, ["bbox", "year"])
    df, skipped = tables.scan_class_column(spark, root)
    assert "ReadSchema: struct<CDL:string>" in plan(df)
    assert df.count() == tables.read_observations(spark, root).count() and skipped.isEmpty()


def test_schema_mismatch_is_reported(spark):
    with pytest.raises(ValueError, match="scl"):
        schemas.require(spark.createDataFrame([("a",)], "scl string"), schemas.OBSERVATIONS)
