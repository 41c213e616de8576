"""Streams leave the tables a batch job would."""

import os
import time

from pyspark.sql import functions as F

from fieldtide import schemas
from fieldtide.constants import SERIES
from fieldtide.operators import quality, series as sr
from fieldtide.plans import catalog
from fieldtide.session import shared_root
from fieldtide.sources import derived
from fieldtide.streaming import commits, ingest


def _halves(spark, sf_dir, folder):
    """Two files that share some (bbox, year) partitions."""
    rows = derived.table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < "1998-06-01"
    rows.where(early).coalesce(1).write.mode("append").parquet(folder)
    yield
    rows.where(~early).coalesce(1).write.mode("append").parquet(folder)
    yield


def test_refresh_in_two_steps(spark, sf_dir, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for _ in _halves(spark, sf_dir, src):
        files = ingest.read_files(spark, src, schemas.SOURCES["lineitem"], "*.parquet", 1)
        ingest.refresh_series(derived.observations_of(files), f"{out}/obs", f"{out}/series",
                              f"{out}/progress")
    cols = [*SERIES, "num_images", "last_day", "day_sum"]
    got = spark.read.parquet(f"{out}/series").select(*cols)
    obs = quality.clean_numeric(quality.scl_mask(derived.observations(spark, sf_dir)))
    want = sr.build_series(obs).select(*cols)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def _ingested(spark, sf_dir, tmp_path, files):
    """Observations after ingesting lists of tables, one file of each list per batch."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for step, table in enumerate(files):
        table.coalesce(1).write.mode("append").parquet(src)
        for attempt in range(2):  # the second attempt lost its progress
            stream = ingest.read_files(spark, src, schemas.SOURCES["lineitem"], "*.parquet", 1)
            ingest.ingest_observations(
                derived.observations_of(stream), out, str(tmp_path / f"p{step}{attempt}"), ["bbox", "year"])
    return spark.read.schema(schemas.OBSERVATIONS).parquet(out)


def _wanted(spark, sf_dir):
    return quality.clean_numeric(quality.scl_mask(derived.observations(spark, sf_dir)))


def test_scene_split_over_files_is_whole(spark, sf_dir, tmp_path):
    rows = derived.table(spark, sf_dir, "lineitem")
    half = F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == 0  # cuts through every scene
    got, want = _ingested(spark, sf_dir, tmp_path, [rows.where(half), rows.where(~half)]), _wanted(spark, sf_dir)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).isEmpty()


def test_rows_twice_in_a_batch_are_stored_once(spark, sf_dir, tmp_path):
    rows = derived.table(spark, sf_dir, "lineitem")
    got, want = _ingested(spark, sf_dir, tmp_path, [rows.union(rows)]), _wanted(spark, sf_dir)
    assert got.count() == want.count()


def test_counts_are_updated_in_place(spark, sf_dir, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = derived.table(spark, sf_dir, "events").orderBy("ts")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    for part in (rows.where(half & (F.dayofmonth("ts") > 0)), rows.where(~half)):
        part.coalesce(1).write.mode("append").parquet(src)
    events = ingest.read_files(spark, src, schemas.SOURCES["events"], "*.parquet", 1)
    ingest.class_counts(events, out, str(tmp_path / "p"), "ts", "event_type", delay="4000 days")
    got = spark.read.parquet(out).groupBy("window_start", "event_type").agg(F.sum("count").alias("n"), F.count("*").alias("k"))
    assert got.where("k > 1").isEmpty()
    assert got.agg(F.sum("n")).first()[0] == rows.count()


def _refreshed(spark, tmp_path, progress, per_batch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    files = ingest.read_files(spark, src, schemas.SOURCES["lineitem"], "*.parquet", per_batch)
    ingest.refresh_series(derived.observations_of(files), f"{out}/obs", f"{out}/series", str(tmp_path / progress))
    return commits.read(spark, f"{out}/obs", ingest.AOI_YEAR)


def _equals_batch(spark, sf_dir, tmp_path):
    cols = [*SERIES, "num_images", "last_day", "day_sum"]
    got = spark.read.parquet(str(tmp_path / "out" / "series")).select(*cols)
    want = sr.build_series(_wanted(spark, sf_dir)).select(*cols)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def _parts(spark, tmp_path):
    rows = spark.read.parquet(str(tmp_path / "out" / "obs" / "rows"))
    return rows.groupBy(*ingest.AOI_YEAR).agg(F.countDistinct("part").alias("n")).agg(F.max("n")).first()[0]


def test_lost_checkpoint_and_other_batches_store_nothing_twice(spark, sf_dir, tmp_path):
    for _ in _halves(spark, sf_dir, str(tmp_path / "in")):
        pass
    want = _wanted(spark, sf_dir).count()
    assert _refreshed(spark, tmp_path, "one", 1).count() == want
    assert _refreshed(spark, tmp_path, "lost", None).count() == want  # both files in one batch
    _equals_batch(spark, sf_dir, tmp_path)
    assert _parts(spark, tmp_path) == 2
    root = str(tmp_path / "out" / "obs")
    commits.compact(spark, root, ingest.AOI_YEAR)
    assert _parts(spark, tmp_path) == 1 and commits.read(spark, root, ingest.AOI_YEAR).count() == want
    assert _refreshed(spark, tmp_path, "again", 1).count() == want  # files merged long ago
    assert _parts(spark, tmp_path) == 1
    _equals_batch(spark, sf_dir, tmp_path)


def test_files_that_come_after_a_merge_are_added(spark, sf_dir, tmp_path):
    halves = _halves(spark, sf_dir, str(tmp_path / "in"))
    next(halves)
    _refreshed(spark, tmp_path, "p", 1)
    commits.compact(spark, str(tmp_path / "out" / "obs"), ingest.AOI_YEAR)
    next(halves)
    assert _refreshed(spark, tmp_path, "p", 1).count() == _wanted(spark, sf_dir).count()
    commits.compact(spark, str(tmp_path / "out" / "obs"), ingest.AOI_YEAR)
    assert _parts(spark, tmp_path) == 1
    _equals_batch(spark, sf_dir, tmp_path)


def test_runs_that_stop_half_way(spark, sf_dir, tmp_path, monkeypatch):
    """Rows without their log entry, and a log entry without its cleaning, count neither twice nor not at all."""
    for _ in _halves(spark, sf_dir, str(tmp_path / "in")):
        pass
    want, root = _wanted(spark, sf_dir).count(), str(tmp_path / "out" / "obs")
    with monkeypatch.context() as broken:
        broken.setattr(commits, "remove_dead", lambda *_: 0)
        _refreshed(spark, tmp_path, "p", 1)
        commits.compact(spark, root, ingest.AOI_YEAR)
    assert commits.read(spark, root, ingest.AOI_YEAR).count() == want and _parts(spark, tmp_path) == 3
    assert commits.remove_dead(spark, root, ingest.AOI_YEAR) > 0 and _parts(spark, tmp_path) == 1
    # parts of a run that stopped before its log entry
    stray = commits.read(spark, root, ingest.AOI_YEAR).limit(50).withColumn("part", F.lit("stray"))
    stray.write.partitionBy(*ingest.AOI_YEAR, "part").mode("append").parquet(f"{root}/rows")
    assert commits.read(spark, root, ingest.AOI_YEAR).count() == want
    commits.compact(spark, root, ingest.AOI_YEAR)
    assert _parts(spark, tmp_path) == 1 and commits.read(spark, root, ingest.AOI_YEAR).count() == want


def test_dedup_over_files_restarts_and_lost_checkpoints(spark, sf_dir, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = derived.table(spark, sf_dir, "lineitem")
    want = derived.observations(spark, sf_dir).select(*ingest.OBSERVATION).distinct()
    states = []
    for progress in ("p", "p", "lost"):  # each file holds rows twice and repeats those of the last
        rows.union(rows.limit(500)).coalesce(1).write.mode("append").parquet(src)
        stream = ingest.read_files(spark, src, schemas.SOURCES["lineitem"], "*.parquet", 1)
        states += ingest.dedup_observations(
            derived.observations_of(stream), out, str(tmp_path / progress), "4000 days")
        got = spark.read.parquet(out)
        assert got.count() == want.count() == got.select(*ingest.OBSERVATION).distinct().count()
    assert max(states) == want.count()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "HDFS").count("RocksDB") == 0
    assert list((tmp_path / "p" / "state").rglob("*.changelog"))


def test_counts_of_a_null_class_are_replaced(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in (1, 1):
        spark.createDataFrame([(k, "2024-01-01 05:00:00", None) for k in range(n)], "event_id long, ts string, event_type string") \
            .selectExpr("event_id", "cast(ts as timestamp) ts", "event_type").coalesce(1).write.mode("append").parquet(src)
    stream = ingest.read_files(
        spark, src, spark.read.parquet(src).schema, "*.parquet", 1)
    ingest.class_counts(stream, out, str(tmp_path / "p"), "ts", "event_type", delay="4000 days")
    assert [r["count"] for r in spark.read.parquet(out).collect()] == [2]


def test_batches_behind_the_state_are_not_grouped_again(spark, sf_dir, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = derived.table(spark, sf_dir, "lineitem")
    rows.union(rows).coalesce(1).write.parquet(src)
    want = derived.observations(spark, sf_dir).select(*ingest.OBSERVATION).distinct().count()
    monkeypatch.setattr(type(rows), "dropDuplicates", lambda *_: (_ for _ in ()).throw(AssertionError("grouped again")))
    for progress in ("p", "lost"):
        stream = ingest.read_files(spark, src, schemas.SOURCES["lineitem"], "*.parquet", 1)
        ingest.dedup_observations(derived.observations_of(stream), out, str(tmp_path / progress), "4000 days")
        assert spark.read.parquet(out).count() == want


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if os.path.basename(f).startswith("shuffle_")}


def test_dedup_compares_by_slices_and_keeps_no_shuffle(spark, sf_dir, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = derived.table(spark, sf_dir, "lineitem")
    early = F.col("l_shipdate") < "1998-06-01"
    all_obs = derived.observations(spark, sf_dir)
    want = all_obs.select(*ingest.OBSERVATION).distinct()
    most = all_obs.groupBy("bbox", "year").count().agg(F.max("count")).first()[0]
    n, sizes, append = want.count(), [], ingest._append_fresh

    def counted(batch, root, partitions, *more, **named):
        sizes.append((batch.count(), batch.select(*partitions).distinct().count()))
        append(batch, root, partitions, *more, **named)

    monkeypatch.setattr(ingest, "SLICE_ROWS", most)
    monkeypatch.setattr(ingest, "_append_fresh", counted)
    for progress, part in (("p", rows.where(early)), ("lost", rows.where(~early)), ("again", rows.limit(0))):
        part.union(part).coalesce(1).write.mode("append").parquet(src)
        sizes.clear()
        before = _shuffle_files(spark)
        stream = ingest.read_files(spark, src, schemas.SOURCES["lineitem"], "*.parquet")
        ingest.dedup_observations(derived.observations_of(stream), out, str(tmp_path / progress), "4000 days")
        end = time.time() + 20
        while (left := _shuffle_files(spark) - before) and time.time() < end:
            time.sleep(0.2)  # files are removed in the background
        assert not left
        if progress != "p":  # all rows come again, in one batch
            assert sum(k for k, _ in sizes) == n and len(sizes) > 3
            assert all(k <= most for k, _ in sizes)
    got = spark.read.parquet(out)
    assert got.count() == n and got.select(*ingest.OBSERVATION).exceptAll(want).isEmpty()
    kept = got.select(*all_obs.columns)
    assert kept.exceptAll(all_obs).isEmpty()
    assert spark.conf.get(ingest.FREE_SHUFFLES, "false") == "false"


def test_packed_columns_come_back(spark):
    names = ["a", "b", "c", "d", "e"]
    rows = spark.createDataFrame(
        [("k", 7, 1, 2, None, 4, 5), (None, None, 32767, -32768, 0, -1, 1), ("l", 1, 32768, 2, None, 4, 2**31 - 1),
         ("m", 2, -32769, None, 0, 0, -(2**31)), ("n", 3, None, None, None, None, None)],
        "key string, year int, " + ", ".join(f"{c} int" for c in names))
    keys = ["key", "year"]
    packed = ingest._packed(rows, keys)
    assert not set(names) & set(packed.columns)
    assert packed.where("_small is null").count() == 2 and packed.where("_large is null").count() == 3
    back = ingest._unpacked(packed, rows.schema, keys)
    assert back.columns == rows.columns and back.dtypes == rows.dtypes
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    few = rows.select("key", "year", "a", "b")
    assert ingest._unpacked(ingest._packed(few, keys), few.schema, keys).columns == few.columns == ingest._packed(few, keys).columns


def test_lost_progress_takes_no_room(spark, sf_dir):
    before = set(os.listdir(shared_root(spark).removeprefix("file://")))
    got = catalog.QUERIES["stream_dedup_observations"](spark, sf_dir)
    left = set(os.listdir(shared_root(spark).removeprefix("file://"))) - before
    assert [x for x in left if x.startswith("unique-obs-")]
    assert not [x for x in left if x.startswith(("progress-", "batch-"))]
    assert got.where("images <> 1").isEmpty()
