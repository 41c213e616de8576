"""Writing tables: partition layout, idempotent re-runs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtide import schemas
from fieldtide.constants import HIGH_CONFIDENCE, SCENE

SAMPLE_COLUMNS = ["CDL", "lon", "lat", "bbox", "year"]


def append_samples(samples: DataFrame, root: str) -> None:
    """Append label points by (bbox, year) in fixed column order."""
    (samples.select(*SAMPLE_COLUMNS).hint("rebalance", F.col("bbox"), F.col("year"))
     .write.partitionBy("bbox", "year").mode("append").parquet(root))


def append_observations(
    obs: DataFrame, root: str, keys: list[str] = SCENE, spread: int = 1,
) -> None:
    """Append observations by (bbox, year, tile, scene_date), or coarser keys.

    Rows meet their scene before the write, so a scene becomes a few files rather
    than one per task. `spread` files share a scene; raise it when single scenes
    are larger than one task should write. The rebalance hint lets adaptive
    execution split a scene that is far larger than the others.
    """
    rows = schemas.require(obs, schemas.OBSERVATIONS)
    by = [F.col(c) for c in keys]
    if spread > 1:
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("lon", "lat"), F.lit(spread)))
        rows = rows.hint("rebalance", *by, F.col("_part")).drop("_part")
    else:
        rows = rows.hint("rebalance", *by)
    rows.write.partitionBy(*keys).mode("append").parquet(root)


def replace_partitions(df: DataFrame, root: str, keys: list[str]) -> None:
    """Write df and replace exactly the partitions it holds; re-runs change nothing."""
    (df.hint("rebalance", *[F.col(k) for k in keys])
     .write.partitionBy(*keys).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").parquet(root))


def write_series(series: DataFrame, root: str) -> None:
    """Series table by (bbox, year)."""
    replace_partitions(series, root, ["bbox", "year"])


def write_training_set(examples: DataFrame, root: str) -> None:
    """Feature rows by split."""
    replace_partitions(examples, root, ["split"])


def drop_table(spark: SparkSession, root: str) -> None:
    """Remove a stored table, wherever Spark can write; a missing one is fine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_results(results: DataFrame, root: str, threshold: float = HIGH_CONFIDENCE) -> None:
    """Results plus their high-confidence subset; without sure rows no subset is left there."""
    spark = results.sparkSession
    results.write.mode("overwrite").parquet(f"{root}/predictions")
    sure = spark.read.parquet(f"{root}/predictions").where(F.col("confidence_score") >= threshold)
    if sure.isEmpty():
        drop_table(spark, f"{root}/high_confidence")
    else:
        sure.write.mode("overwrite").parquet(f"{root}/high_confidence")


def write_sweep_csv(report: DataFrame, root: str) -> None:
    """Configuration report as CSV with a header (one row per configuration)."""
    report.coalesce(1).write.mode("overwrite").option("header", True).csv(root)
