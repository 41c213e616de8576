"""Reports over label counts and configuration sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.constants import CULTIVATED, LEGEND
from fieldtide.operators.labels import complete_legend


def class_balance(
    counts: DataFrame, threshold: float, legend: Sequence[str] = LEGEND,
) -> DataFrame:
    """Share of every legend class, scarce classes flagged, and the overall verdict."""
    everything = Window.partitionBy()  # a handful of legend rows
    share = F.col("count") / F.sum("count").over(everything)
    return (
        complete_legend(counts, legend)
        .withColumn("share", F.coalesce(share, F.lit(0.0)))
        .withColumn("scarce", F.col("share") < threshold)
        .withColumn("imbalanced", F.bool_or("scarce").over(everything))
    )


def summarise(labelled: DataFrame, legend: Sequence[str] = LEGEND) -> DataFrame:
    """Label distribution and cultivated share per configuration, one pass."""
    per_label = [F.count_if(F.col("label") == i).alias(f"label_{i}") for i in range(len(legend))]
    return labelled.groupBy("config").agg(
        F.count(F.lit(1)).alias("total_samples"),
        F.count_if(F.col("label") == CULTIVATED).alias("cultivated_count"),
        F.avg((F.col("label") == CULTIVATED).cast("int")).alias("cultivated_ratio"),
        *per_label)


def top_configs(summary: DataFrame, n: int = 5) -> DataFrame:
    """Configurations with the largest cultivated share, best first."""
    order = [F.desc("cultivated_ratio"), F.asc("config")]
    # One row per configuration: the window sees a short report, never the data.
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).where(
        F.col("rank") <= n)
