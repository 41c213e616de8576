"""A partitioned table fed file by file, with a log that says which of its rows count.

Rows of a source file are stored in a part of their own in every partition they touch. The log
names the part in which the rows of a (partition, source file) are, in rising versions; the
newest one counts. So a file that comes again, in whatever batch, is known by the log or replaces
its own part, and many small parts can be merged into one: the merged rows count from the moment
the log says so, and only then the small parts are removed. A reader sees either.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldtide.sources import sinks

SOURCE, PART, VERSION = "source", "part", "version"


def tagged(stream: DataFrame) -> DataFrame:
    """Rows with the file they come from. Only selections and filters may lie before.

    (The metadata column of the reader would say the same, but keeps the selections before it
    from being merged, which made the scan seven times as long.)
    """
    return stream.withColumn(SOURCE, F.md5(F.input_file_name()))


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root}/log")
    except AnalysisException:
        return None


def live_parts(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame | None:
    """(keys, source, part): where the rows of each source file are that touch a partition."""
    log = _log(spark, root)
    if log is None:
        return None
    newest = Window.partitionBy(*keys, SOURCE).orderBy(F.col(VERSION).desc(), PART)
    return log.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*keys, SOURCE, PART)


def read(spark: SparkSession, root: str, keys: Sequence[str], only: DataFrame | None = None) -> DataFrame:
    """Rows that count, without their part; `only` names the partitions wanted.

    Keys and part are partition columns, so files of other partitions and dead parts are not read.
    """
    live = live_parts(spark, root, keys).where(F.col(PART).isNotNull()).select(*keys, PART).distinct()
    if only is not None:
        live = live.join(only, reduce(and_, [live[k].eqNullSafe(only[k]) for k in keys]), "left_semi")
    rows = spark.read.parquet(f"{root}/rows")
    same = [rows[c].eqNullSafe(live[c]) for c in (*keys, PART)]
    return rows.join(live, reduce(and_, same), "left_semi").drop(PART)


def commit(batch: DataFrame, root: str, keys: Sequence[str]) -> None:
    """Store the rows of source files that the log does not know, then log them.

    A run that stops between the two leaves parts that do not count; the next run replaces them.
    """
    spark = batch.sparkSession
    done = live_parts(spark, root, keys)
    fresh = batch if done is None else batch.join(done.select(SOURCE).distinct(), SOURCE, "left_anti")
    sinks.replace_partitions(fresh.withColumn(PART, F.col(SOURCE)).drop(SOURCE), f"{root}/rows", [*keys, PART])
    named = fresh.select(*keys, SOURCE).distinct()
    named.withColumns({PART: F.col(SOURCE), VERSION: F.lit(0)}).write.mode("append").parquet(f"{root}/log")


def compact(spark: SparkSession, root: str, keys: Sequence[str], parts: int = 1) -> None:
    """Merge the parts of every partition that has more than `parts` of them; then remove them.

    Stopped before the log is written, nothing has changed; behind it, the small parts are dead
    and the next run removes them. It must not run beside another writer of the table.
    """
    live = live_parts(spark, root, keys)
    if live is None:
        return
    version = _log(spark, root).agg(F.max(VERSION)).first()[0] + 1
    many = live.groupBy(*keys).agg(F.countDistinct(PART).alias("n")).where(F.col("n") > parts).select(*keys)
    merged = f"merged-{version}"
    moved = live.join(many, list(keys), "left_semi")
    if not moved.isEmpty():
        rows = read(spark, root, keys, many).withColumn(PART, F.lit(merged))
        sinks.replace_partitions(rows, f"{root}/rows", [*keys, PART])
        moved.select(*keys, SOURCE).withColumns({PART: F.lit(merged), VERSION: F.lit(version)}).write.mode(
            "append").parquet(f"{root}/log")
    remove_dead(spark, root, keys)


def remove_dead(spark: SparkSession, root: str, keys: Sequence[str]) -> int:
    """Remove the folders of parts that do not count; their number."""
    live = live_parts(spark, root, keys).select(*keys, PART).distinct()
    stored = spark.read.parquet(f"{root}/rows")
    folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    stored = stored.select(*keys, PART, folder.alias("folder")).distinct()
    same = [stored[c].eqNullSafe(live[c]) for c in (*keys, PART)]
    dead = [r["folder"] for r in stored.join(live, reduce(and_, same), "left_anti").select("folder").collect()]
    for path in dead:  # one name per dead folder
        sinks.drop_table(spark, _plain(path))
    return len(dead)


def _plain(path: str) -> str:
    """A file path as Hadoop writes it: the metadata column shows it as an encoded URI."""
    from urllib.parse import unquote

    return unquote(path)
