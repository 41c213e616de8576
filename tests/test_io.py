"""Round trips, errors and re-runs of sources and sinks."""

import os

import pytest
from pyspark.sql import functions as F

from fieldtide.constants import SCENE, SERIES
from fieldtide.functions import geo, packing, text
from fieldtide.operators import assess, model, quality, scenes as sc, series as sr
from fieldtide.plans.series_queries import masked
from fieldtide.session import shared_folder
from fieldtide.sources import derived, sinks, tables


def test_pack_round_trip(spark, sf_dir):
    whole = sr.build_series(masked(spark, sf_dir))
    back = sr.unpack_series(sr.pack_series(whole)).select(*whole.columns)
    assert whole.exceptAll(back).isEmpty() and back.exceptAll(whole).isEmpty()


@pytest.mark.parametrize("value", [-1, 65536])
def test_words_outside_their_range_fail(spark, value):
    df = spark.createDataFrame([([1, value],)], "v array<int>")
    with pytest.raises(Exception, match="outside 0..65535"):
        df.select(packing.pack_words(F.col("v"))).collect()


def test_empty_blob(spark):
    df = spark.createDataFrame([(bytearray(b""),)], "b binary")
    row = df.select(packing.unpack_words(F.col("b")), packing.unpack_rows(F.col("b"))).first()
    assert list(row) == [[], []]


def test_scene_layout_and_inventory(spark, sf_dir):
    obs = masked(spark, sf_dir).where((F.col("year") == 1997) & (F.col("lon") < -90.599))
    root = shared_folder(spark, "scenes")
    sinks.append_observations(obs, root)
    back = tables.read_observations(spark, root)
    assert back.count() == obs.count()
    assert back.schema["scene_date"].dataType.simpleString() == "date"
    assert sc.skip_existing(obs, back, SCENE).isEmpty()
    listed = tables.partition_inventory(back).select(F.sum(F.size("scene_dates"))).first()[0]
    assert listed == obs.select(*SCENE).distinct().count()


def test_scan_any_finds_files_and_reports_none(spark, sf_dir, tmp_path):
    one = tables.scan_any(spark, f"{sf_dir}/part.parquet").count()
    assert one == tables.scan_any(spark, f"{sf_dir}/par*").count()
    deep = tmp_path / "a" / "b"
    spark.range(5).write.parquet(str(deep))
    assert tables.scan_any(spark, str(tmp_path)).count() == 5
    with pytest.raises(FileNotFoundError):
        tables.scan_any(spark, str(tmp_path / "missing"))


def test_storage_size(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    want = sum(os.path.getsize(tmp_path / "t" / f) for f in os.listdir(tmp_path / "t")
               if not f.startswith((".", "_")))
    assert tables.storage_size(spark, str(tmp_path)).first().total_bytes == want


def test_results_without_sure_rows_write_no_subset(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.4)], "prediction int, confidence_score double")
    sinks.write_results(rows, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["predictions"]


def test_sweep_resumes_after_a_stop(spark, tmp_path):
    calls = []

    def score(days):
        calls.append(days)
        return spark.createDataFrame([(d, d * 2) for d in days], "start_day int, x int")

    root = str(tmp_path / "r")
    model.resume_sweep(spark, root, [0, 15], score)
    out = model.resume_sweep(spark, root, [0, 15, 30], score)
    assert calls == [[0, 15], [30]] and out.count() == 3


def test_infinite_and_missing_assets_are_dropped(spark, sf_dir):
    obs = derived.observation_gaps(spark, sf_dir).limit(50)
    odd = obs.withColumn("scl", F.lit(float("inf"))).unionByName(
        obs.withColumn("scl", F.lit(float("nan")))).unionByName(
        obs.withColumn("scl", F.lit(None).cast("double")))
    assert quality.clean_numeric(odd).isEmpty()


def test_albers_known_points(spark):
    # The projection origin, and a corner of the contiguous grid on its central meridian.
    df = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    lon, lat = df.select(*geo.albers_to_lonlat(F.col("x"), F.col("y"))).first()
    assert abs(lon + 96) < 1e-9 and abs(lat - 23) < 1e-7


def test_text_helpers(spark):
    df = spark.createDataFrame([("S2A_15SYV_20191127_1_L2A", "a, b|c", "1, 2,3, -4")],
                               "id string, arg string, bbox string")
    row = df.select(
        text.scene_base(F.col("id")), text.scene_tile(F.col("id")),
        text.split_list(F.col("arg")), geo.parse_bbox(F.col("bbox"))).first()
    assert list(row) == ["S2A_15SYV_20191127", "15SYV_1", ["a, b", "c"], [1, 2, 3, -4]]


def test_prediction_tables_are_harmonised(spark):
    df = spark.createDataFrame([(1,)], "predicted_class int")
    assert assess.harmonise(df).columns == ["prediction"]


def test_series_columns(spark, sf_dir):
    assert sr.build_series(masked(spark, sf_dir)).columns[:5] == SERIES


def test_a_second_run_replaces_the_sure_subset(spark, tmp_path):
    root = str(tmp_path)
    for confidence in (0.9, 0.4):
        sinks.write_results(
            spark.createDataFrame([(1, confidence)], "id int, confidence_score double"), root, 0.5)
    assert spark.read.parquet(f"{root}/predictions").first().confidence_score == 0.4
    assert os.listdir(root) == ["predictions"]


def test_unreadable_files_are_listed(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.createDataFrame([("Corn",), ("Rice",)], "CDL string").coalesce(1).write.parquet(root)
    (tmp_path / "t" / "bad.parquet").write_bytes(b"PAR1 not a table PAR1")
    rows, skipped = tables.scan_class_column(spark, root)
    assert rows.count() == 2
    assert [r.path.rsplit("/", 1)[1] for r in skipped.collect()] == ["bad.parquet"]


def test_legend_codes_of_any_size(spark):
    from fieldtide.operators import raster

    legend = "Codes int, Class_Names string, ESRI_Red int, ESRI_Green int, ESRI_Blue int"
    cells = spark.createDataFrame([(300,), (-4,), (7,)], "code int")
    rows = [(300, "A", 1, 2, 3), (-4, "B", 4, 5, 6), (9, None, 1, 1, 1), (9, None, 2, 2, 2)]
    got = {r.code: (r.class_name, r.red) for r in raster.decode_classes(
        cells, spark.createDataFrame(rows, legend)).collect()}
    assert got == {300: ("A", 1), -4: ("B", 4), 7: (None, 0)}
    twice = spark.createDataFrame([*rows, (300, "C", 1, 2, 3)], legend)
    with pytest.raises(Exception, match="several rows"):
        raster.decode_classes(cells, twice).collect()


def test_centroids_out_of_range_fail(spark):
    from fieldtide.constants import CHANNELS

    row = spark.createDataFrame([(9, 0, *[1.0] * len(CHANNELS))], ["label", "bucket", *[f"m_{c}" for c in CHANNELS]])
    with pytest.raises(ValueError, match="outside"):
        model.centroid_model(row, 25)


def test_finished_groups_survive_a_failure(spark, tmp_path):
    root, calls = str(tmp_path / "s"), []

    def run(days):
        calls.append(days)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return spark.createDataFrame([(d, d * 10) for d in days], "start_day int, v int")

    with pytest.raises(RuntimeError):
        model.resume_sweep(spark, root, list(range(10)), run, 3)
    assert model.finished_days(spark, root) == [0, 1, 2, 3, 4, 5]
    whole = model.resume_sweep(spark, root, list(range(10)), run, 3)
    assert calls[3:] == [[6, 7, 8], [9]] and sorted(r.v for r in whole.collect()) == [d * 10 for d in range(10)]


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from fieldtide import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None),
                           sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(fake)


def test_storage_size_of_any_file(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    assert tuple(tables.storage_size(spark, str(tmp_path)).first()) == (1, 5)
