"""Reading stored tables: partition pruning, file discovery, inventories."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtide import schemas
from fieldtide.constants import DOUBLE_CROP_MARK


def read_observations(spark: SparkSession, root: str) -> DataFrame:
    """Stored observations; the schema is fixed, so no file is opened to infer it."""
    return schemas.require(
        spark.read.schema(schemas.OBSERVATIONS).parquet(root), schemas.OBSERVATIONS)


def scan_partition(obs: DataFrame, bbox: str, year: int) -> DataFrame:
    """Observations of one AOI and year; both keys prune partitions of a stored table."""
    return obs.where((F.col("bbox") == bbox) & (F.col("year") == year))


def split_by_year(df: DataFrame, splits: dict[str, list[int]]) -> DataFrame:
    """Tag rows with the split that owns their year and drop years nobody owns."""
    tag = F.lit(None).cast("string")
    for name, years in splits.items():
        tag = F.when(F.col("year").isin(years), F.lit(name)).otherwise(tag)
    owned = sorted({y for years in splits.values() for y in years})
    return df.where(F.col("year").isin(owned)).withColumn("split", tag)


def scan_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet under a file, a directory tree or a glob; raises when nothing is found.

    With a schema the partition columns of the path are part of it, so the tree
    is read as one partitioned table; without one, files are found at any depth.
    """
    reader = spark.read.option("pathGlobFilter", "*.parquet")
    reader = reader.schema(schema) if schema else reader.option("recursiveFileLookup", True)
    try:
        df = reader.parquet(path)
        found = bool(df.limit(1).inputFiles()) if schema else True
    except AnalysisException as missing:
        raise FileNotFoundError(f"no parquet files under {path}") from missing
    if not found:
        raise FileNotFoundError(f"no parquet files under {path}")
    return df


def scan_class_column(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Only the class column of many files, and the paths of files that gave no row.

    Files that cannot be read are skipped by the first table and listed by the second, as are
    empty ones; nothing is left out silently.
    """
    found = (
        spark.read.schema("CDL string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .option("ignoreCorruptFiles", True)
        .parquet(path)
    )
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet").load(path).select("path")
    )
    read = found.select(F.col("_metadata.file_path").alias("path")).distinct()
    return found.select("CDL"), listed.join(read, "path", "left_anti")


def partition_inventory(obs: DataFrame) -> DataFrame:
    """Stored scene dates per (bbox, year, tile).

    Rows are first reduced to distinct scenes on the map side, so a list holds at
    most the days of one year whatever the row count of a tile.
    """
    return (
        obs.select("bbox", "year", "tile", "scene_date").distinct()
        .groupBy("bbox", "year", "tile")
        .agg(F.sort_array(F.collect_list("scene_date")).alias("scene_dates"))
    )


def distinct_partitions(df: DataFrame) -> DataFrame:
    return df.select("bbox", "year").distinct()


def storage_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes under a path, from the listing alone (no content is read)."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .agg(F.count(F.lit(1)).alias("files"),
             F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
    )


def sorted_years(df: DataFrame, column: str = "year") -> DataFrame:
    """Distinct values of a key as one sorted array."""
    return df.select(column).distinct().agg(
        F.sort_array(F.collect_list(column)).alias("values"))


def tag_constants(df: DataFrame, bbox: str, year: int) -> DataFrame:
    """Attach AOI and year to a table that was read from below their partition."""
    return df.withColumn("bbox", F.lit(bbox)).withColumn("year", F.lit(year).cast("int"))


def drop_double_crops(df: DataFrame) -> DataFrame:
    return df.where(~F.col("CDL").contains(DOUBLE_CROP_MARK))
