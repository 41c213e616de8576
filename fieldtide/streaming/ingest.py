"""Restartable ingestion with Structured Streaming.

Every sink below is idempotent: a batch that runs again after a failure, or files that come again
in other batches after the checkpoint is lost, leave the table as one successful run would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtide.operators import quality, series as sr
from fieldtide.session import durable, shared_folder
from fieldtide.sources import sinks
from fieldtide.streaming import commits


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType, glob: str, per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream; per_batch bounds the files of one batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


#: State of streams on disk with a log of its changes, so a checkpoint writes what has changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query keeps the state store it was started with; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, sink: Callable, checkpoint: str, mode: str = "append") -> list[int]:
    """Process what is there now and stop; the checkpoint remembers it for the next run.

    Returns the number of keys in state behind each batch of the run (of stateful streams).
    """
    with _state_on_disk(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(sink).outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def stored_or_none(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(root)
    except AnalysisException:
        return None


def _touched(spark: SparkSession, root: str, batch: DataFrame, partitions: Sequence[str]) -> DataFrame | None:
    """Stored rows of the partitions a batch touches; the others are not read."""
    done = stored_or_none(spark, root)
    if done is None:
        return None
    mine = batch.select(*partitions).distinct()
    return done.join(F.broadcast(mine), list(partitions), "left_semi")  # one row per partition


def _append_fresh(
    batch: DataFrame, root: str, partitions: Sequence[str], keys: Sequence[str], unique: bool = False,
) -> None:
    """Append the rows whose keys are not stored yet, each once; `unique`: no key is twice in the batch."""
    fresh = batch if unique else batch.dropDuplicates(list(keys))
    done = _touched(batch.sparkSession, root, batch, partitions)
    if done is not None:
        same = [fresh[c].eqNullSafe(done[c]) for c in keys]
        fresh = fresh.join(done, reduce(and_, same), "left_anti")
    fresh.write.partitionBy(*partitions).mode("append").parquet(root)


def ingest_scenes(
    stream: DataFrame, root: str, checkpoint: str, partitions: Sequence[str],
    keys: Sequence[str] | None = None,
) -> None:
    """Append rows that are not stored yet; `keys` identify a row (by default all columns do).

    Rows are told apart one by one, not scene by scene: a scene whose rows arrive in several
    batches is stored whole, and a row that arrives again, in the same batch, in a later file or
    in a repeated batch, is stored once.
    """
    drain(stream, lambda batch, _: _append_fresh(batch, root, partitions, keys or batch.columns), checkpoint)


def ingest_observations(
    stream: DataFrame, root: str, checkpoint: str, partitions: Sequence[str],
) -> None:
    """Mask, clean and append sampled observations, each once."""
    ingest_scenes(quality.clean_numeric(quality.scl_mask(stream)), root, checkpoint, partitions)


def _once(sink: Callable) -> Callable:
    """A sink that reads its batch from a table: the state of a stream is run once per batch."""
    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        root = shared_folder(spark, "batch")
        batch.write.parquet(root)
        sink(spark.read.schema(batch.schema).parquet(root), number)
        sinks.drop_table(spark, root)

    return store


#: What makes an observation: a pixel in one image of one tile of an AOI and year.
OBSERVATION = ["bbox", "year", "tile", "scene_date", "lon", "lat"]

#: Rows of a batch that are compared with the table at a time, by whole partitions.
SLICE_ROWS = 5_000_000
#: Partitions named in the filter of one slice.
SLICE_PARTITIONS = 200
#: Spark removes the shuffle files of a query when it ends, not when the driver collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _packed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The int columns beside the keys as one array, of two bytes a value in rows where all fit.

    A shuffled row spends eight bytes on every column.
    """
    ints = _ints(rows.schema, keys)
    if not ints:
        return rows
    fits = reduce(and_, [F.coalesce(F.col(c).between(-(2**15), 2**15 - 1), F.lit(True)) for c in ints])
    return rows.select(
        *[c for c in rows.columns if c not in ints],
        F.when(fits, F.array(*[F.col(c).try_cast("smallint") for c in ints])).alias("_small"),
        F.when(~fits, F.array(*ints)).alias("_large"),
    )


def _unpacked(rows: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """What _packed was given."""
    at = {c: i for i, c in enumerate(_ints(schema, keys))}
    return rows.select(*[
        F.coalesce(F.get("_small", F.lit(at[c])).cast("int"), F.get("_large", F.lit(at[c]))).alias(c) if c in at else c
        for c in schema.names])


def _ints(schema: T.StructType, keys: Sequence[str]) -> list[str]:
    """What is worth packing: a few columns take no more than the array around them."""
    ints = [f.name for f in schema if f.dataType == T.IntegerType() and f.name not in keys]
    return ints if len(ints) > 4 else []


def _free_shuffle(batch: DataFrame) -> None:
    """Remove what a stored batch was shuffled to for the state; FREE_SHUFFLES leaves that to the stream."""
    rdd = batch._jdf.queryExecution().toRdd()
    rdd.getNumPartitions()  # resolves the lineage
    rdd.cleanShuffleDependencies(True)


def _slices(rows: DataFrame, partitions: Sequence[str]) -> Iterator[DataFrame]:
    """The rows of a table by groups of its partitions."""
    group, size = [], 0
    for *values, n in rows.groupBy(*partitions).count().collect():  # one row per partition
        if group and (size + n > SLICE_ROWS or len(group) == SLICE_PARTITIONS):
            yield rows.where(reduce(or_, group))
            group, size = [], 0
        group.append(reduce(and_, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(partitions, values, strict=True)]))
        size += n
    if group:
        yield rows.where(reduce(or_, group))


def _store_unique(batch: DataFrame, root: str, partitions: Sequence[str], keys: Sequence[str]) -> None:
    """Append the rows of a batch that holds no key twice whose keys are not stored yet.

    The state is run once, to a scratch table. A large one is compared with the stored rows slice
    by slice, and what a slice was shuffled to is gone before the next.
    """
    spark = batch.sparkSession  # the stream's own
    spark.conf.set(FREE_SHUFFLES, "true")
    scratch = shared_folder(spark, "batch")
    batch.write.parquet(scratch)
    _free_shuffle(batch)
    rows = spark.read.schema(batch.schema).parquet(scratch)
    if stored_or_none(spark, root) is None or rows.count() <= SLICE_ROWS:
        _append_fresh(rows, root, partitions, keys, unique=True)
    else:
        split = shared_folder(spark, "batch")
        rows.write.partitionBy(*partitions).parquet(split)
        sinks.drop_table(spark, scratch)
        scratch = split
        for part in _slices(spark.read.schema(batch.schema).parquet(split), partitions):
            _append_fresh(part, root, partitions, keys, unique=True)
    sinks.drop_table(spark, scratch)


def dedup_scenes(
    stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], time: str, delay: str,
    partitions: Sequence[str] = (),
) -> list[int]:
    """Store the first row of every key that arrives within the watermark; state ends with it.

    Repeats in one batch, in later files and behind a restart are dropped by the state of the
    stream. Rows that come again because the checkpoint was lost, or behind the watermark, are
    dropped against the table, of which only the `partitions` a batch touches are read (by
    default the day of `time`). Returns the number of keys in state behind each batch.
    """
    names = list(partitions) or ["day"]
    rows = stream.withColumn(time, F.col(time).cast("timestamp"))
    if not partitions:
        rows = rows.withColumn("day", F.to_date(time))
    unique = _packed(rows, keys).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    # the state gives each key once, so the wide rows are not shuffled to be grouped again
    return drain(
        unique, lambda batch, _: _store_unique(_unpacked(batch, rows.schema, keys), root, names, keys), checkpoint)


def dedup_observations(stream: DataFrame, root: str, checkpoint: str, delay: str) -> list[int]:
    """One observation per AOI, year, tile, date and pixel, stored by (bbox, year)."""
    days = stream.withColumn("seen", F.col("scene_date").cast("timestamp"))
    return dedup_scenes(days, root, checkpoint, OBSERVATION, "seen", delay, ["bbox", "year"])


#: What decides which series a batch touches.
AOI_YEAR = ["bbox", "year"]


def refresh_series(stream: DataFrame, obs_root: str, series_root: str, checkpoint: str) -> None:
    """Store new observations by source file and rebuild the series of the (bbox, year) they touch.

    Files are told apart, not batches: whatever batches the same files come in, they are stored
    once. The series of all files of a batch are rebuilt, so a run that stopped behind its commit
    is made good by the next.
    """
    def store(batch: DataFrame, _: int) -> None:
        commits.commit(batch, obs_root, AOI_YEAR)
        touched = batch.select(*AOI_YEAR).distinct()
        affected = commits.read(batch.sparkSession, obs_root, AOI_YEAR, touched)
        sinks.write_series(sr.build_series(affected), series_root)

    drain(commits.tagged(quality.clean_numeric(quality.scl_mask(stream))), store, checkpoint)


def class_counts(
    stream: DataFrame, root: str, checkpoint: str, time: str, group: str,
    window: str = "1 day", delay: str = "2 days",
) -> None:
    """Running count per event-time window and class, stored by day.

    Update mode: a batch carries the windows that changed and replaces them in the days it
    touches; a null class is a class. The watermark ends windows, so the state stays as long as the delay.
    """
    counts = (
        stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), group).count()
        .select(F.col("w.start").alias("window_start"), group, "count",
                F.to_date("w.start").alias("day"))
    )

    def store(batch: DataFrame, _: int) -> None:
        done = _touched(batch.sparkSession, root, batch, ["day"])
        if done is not None:
            same = [done[c].eqNullSafe(batch[c]) for c in ("window_start", group)]
            old = done.join(batch, reduce(and_, same), "left_anti")
            batch = durable(batch.unionByName(old.select(*batch.columns)))
        sinks.replace_partitions(batch, root, ["day"])

    drain(counts, _once(store), checkpoint, "update")
