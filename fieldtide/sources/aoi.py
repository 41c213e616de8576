"""AOI configuration and class legend dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_aoi(lines: DataFrame) -> DataFrame:
    """`name|bbox|years` lines to one row per (name, bbox, year); comments are dropped."""
    part = F.split(F.trim("value"), "\\|")
    return (
        lines.withColumn("line", F.monotonically_increasing_id())
        .where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
        .select(
            "line",
            part[0].alias("name"),
            F.regexp_replace(part[1], "\\s", "").alias("bbox"),
            F.explode(F.split(F.trim(part[2]), "\\s*,\\s*").cast("array<int>")).alias("year"),
        )
        .dropDuplicates(["name", "bbox", "year"])
    )


def first_aoi(aoi: DataFrame) -> DataFrame:
    """Unique mode: the first configured AOI with its first year."""
    return aoi.orderBy("line", "year").limit(1)


def bbox_year_grid(aoi: DataFrame, per_aoi: bool = False) -> DataFrame:
    """Every bbox with every configured year, or each bbox with its own years only.

    Both sides are distinct values of a configuration file, so the grid is built
    by exploding two short arrays instead of a join.
    """
    if per_aoi:
        return aoi.select("bbox", "year").distinct()
    return (
        aoi.agg(F.collect_set("bbox").alias("bboxes"), F.collect_set("year").alias("years"))
        .select(F.explode("bboxes").alias("bbox"), "years")
        .select("bbox", F.explode("years").alias("year"))
    )


def legend_dim(legend: DataFrame) -> DataFrame:
    """Legend rows that carry a class name."""
    return legend.dropna(subset=["Class_Names"])
