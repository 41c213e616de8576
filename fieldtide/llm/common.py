"""What several operators share: stored tables, cut-off of hot buckets, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtide.session import durable, shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df, written once to the folder all executors share, and read from there."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one Arrow batch: what a Python worker and its JVM hold of a column of texts at once.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts and their feature rows go to Python in batches of at most BATCH_ROWS.

    Spark's 10,000 rows of 5 KB are 50 MB several times over (Arrow in the JVM, Arrow, strings and
    matrices in the worker), and a worker keeps most of what it once took.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 52) - 1))) / F.lit(float(1 << 52))


def sample_up_to(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows of df by a hash of their keys, all of them when there are fewer.

    The bound holds in expectation (a binomial draw), whatever the size of df.
    """
    total = df.count()
    share = min(1.0, rows / total) if total else 1.0
    return df if share == 1.0 else df.where(unit_hash(F.lit("sample"), *keys) < share)


def pair_blocks(entries: DataFrame, bucket: str, key: str, limit: int) -> DataFrame:
    """Cut buckets of over `limit` entries into blocks and send each entry to its block pairs.

    Every two entries of a bucket meet in exactly one (bucket, lo, hi). `own` tells the block of
    an entry; where lo < hi only entries of different blocks are to be compared, as each block
    meets itself in (b, b). No bucket is dropped or capped. The list of hot buckets always has
    a row (bucket zero), as adaptive execution takes the join with an empty one out of the plan:
    the join gives one row an entry, whether there is a hot bucket or not.
    """
    zero = F.lit(0).cast(entries.schema[bucket].dataType)
    listed = entries.select(bucket).union(entries.sparkSession.range(0, 1, 1, 1).select(zero.alias(bucket)))
    hot = (
        listed.groupBy(bucket).count().where((F.col("count") > limit) | (F.col(bucket) == zero))
        .select(bucket, F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    )
    blocks = F.coalesce("blocks", F.lit(1))
    return (
        entries.join(hot, bucket, "left")
        .withColumn("own", F.pmod(F.xxhash64(F.lit("block"), key), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
        .drop("blocks", "other")
    )


def word_slices(data: bytes, size: int = 1 << 22):
    """data in pieces of about `size` bytes that are cut behind ASCII white space."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r")) + 1
        if cut <= at:
            cuts = [p for p in (data.find(c, at + size) for c in (b" ", b"\n", b"\t", b"\r")) if p >= 0]
            cut = min(cuts) + 1 if cuts else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def grouped_batches(batches, names: tuple[str, ...], rows: int = 200_000):
    """Join Arrow batches that are sorted by the columns `names` into tables that split no group.

    Memory: `rows` plus the longest group.
    """
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        change = np.zeros(size, dtype=bool)
        for name in names:
            column = table[name].to_numpy()
            change[1:] |= column[1:] != column[:-1]
        starts = np.flatnonzero(change)
        if not len(starts):
            continue
        cut = int(starts[-1])
        yield table.slice(0, cut)
        rest = table.slice(cut)
        held, size = rest.to_batches(), rest.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Label of each of n nodes: the smallest node that the links a-b lead to."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        x, y = x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b); the component is the smallest id reachable.

    Each round hooks every id to its smallest neighbour (a minimum, combined before the shuffle,
    so a hub costs no more than other ids), shortens the pointers, and replaces the ends of the
    links that are left. All state is in checkpoints in the shared folder.
    """
    left = durable(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    found = None
    while True:
        both = left.select(F.col("a").alias("id"), F.col("b").alias("to")).union(left.select("b", "a"))
        up = durable(both.groupBy("id").agg(F.least("id", F.min("to")).alias("root")))
        while True:
            step = up.select(F.col("id").alias("root"), F.col("root").alias("above"))
            higher = durable(up.join(step, "root").select(
                "id", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            moved = higher.where("moved").limit(1).count()
            up = higher.drop("moved")
            if not moved:
                break
        found = up if found is None else durable(
            found.join(up.select(F.col("id").alias("root"), F.col("root").alias("above")), "root", "left")
            .select("id", F.coalesce("above", "root").alias("root")))
        ends = up.withColumnsRenamed({"id": "a", "root": "x"})
        others = up.withColumnsRenamed({"id": "b", "root": "y"})
        left = durable(
            left.join(ends, "a").join(others, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        if left.limit(1).count() == 0:
            return found.select("id", F.col("root").alias("component"))
