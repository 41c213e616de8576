"""Labels of windows, and label names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtide.constants import (
    BASE_LABELS, CULTIVATED, LEGEND, NO_CROP, OTHER_CROPS, SCL_VEGETATION, TARGETED_CROPS,
    UNCULTIVATED,
)
from fieldtide.functions import text, vectors


def base_label(
    cdl: Column, targeted: Sequence[str] = TARGETED_CROPS, other: Sequence[str] = OTHER_CROPS,
) -> Column:
    """Annual label of a class name, before the season is looked at."""
    position = F.array_position(text.words(targeted), cdl).cast("int")
    return (
        F.when(position > 0, position + (len(BASE_LABELS) - 1))
        .when(F.array_contains(text.words(other), cdl), F.lit(CULTIVATED))
        .otherwise(F.lit(UNCULTIVATED))
    )


def recent_vegetation(picks: Column, frames: Column | int) -> Column:
    """Whether any of the last `frames` filled buckets shows vegetation; null without any."""
    wanted = F.lit(frames) if isinstance(frames, int) else frames

    def among_last(scl: Column) -> Column:
        n = F.least(wanted, F.size(scl))
        return F.when(F.size(scl) > 0, F.exists(
            F.slice(scl, F.size(scl) - n + 1, n), lambda x: x == SCL_VEGETATION))

    seen = F.filter(F.transform(picks, lambda p: p["scl"]), lambda x: x != 0)
    return vectors.let(seen, among_last)


def assign_label(cdl: Column, vegetation: Column, **lists: Sequence[str]) -> Column:
    """Season label: a crop without recent vegetation is not growing.

    An empty window gives no evidence, so the annual label stands.
    """
    base = base_label(cdl, **lists)
    return F.when((base != UNCULTIVATED) & ~vegetation, F.lit(NO_CROP)).otherwise(base)


def label_windows(cut_series: DataFrame, frames: Column | int) -> DataFrame:
    """Add `vegetation` and `label` to windows that carry `picks`."""
    return (
        cut_series.withColumn("vegetation", recent_vegetation(F.col("picks"), frames))
        .withColumn("label", assign_label(F.col("CDL"), F.col("vegetation")))
    )


def complete_legend(counts: DataFrame, legend: Sequence[str] = LEGEND) -> DataFrame:
    """(label, count) rows for every legend class, absent ones with zero."""
    names = counts.sparkSession.createDataFrame(
        list(enumerate(legend)), "label int, name string")
    return (
        names.join(counts, "label", "left")
        .select("label", "name", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))
    )
