"""Seeded sampling and batching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.functions import text
from fieldtide.session import durable


def series_hash(seed: int = 42) -> Column:
    """Seeded hash of a series key, the same on every engine and attempt."""
    return text.seeded_hash(
        F.col("bbox"), F.col("year"), text.micro_degrees(F.col("lon")),
        text.micro_degrees(F.col("lat")), F.col("CDL"), seed=seed)


def first_row(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row in the given order (one row per task meets the final choice)."""
    return df.orderBy(*order).limit(1)


def bernoulli(df: DataFrame, key_hash: Column, percent: int) -> DataFrame:
    """Independent sample of about `percent` of the rows, by hash."""
    return df.where(key_hash % 100 < percent)


def with_position(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Zero-based global position of every row in the given order.

    Rows are range-partitioned and counted per partition; the offsets (one number
    per partition) are the only thing gathered. No task sees all rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # range bounds are sampled, so the place of a row is fixed by materialising it; the row
    # number inside its partition is the lower part of the monotonic id, no second shuffle
    ranged = durable(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return (
        ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part")
        .withColumn("position", F.col("_offset") + row).drop("_part", "_at", "_offset")
    )


def shuffle_batches(
    df: DataFrame, key_hash: Column, ties: Sequence[str], batch_size: int,
) -> DataFrame:
    """Rows in seeded random order, cut into batches of `batch_size`.

    Hash and ties must name a row: repeated ones are an error. Positions are found for these keys
    alone; the rows themselves move once, to the batch of their key.
    """
    keys = ["_hash", *ties]
    rows = df.withColumn("_hash", key_hash)
    placed = with_position(rows.select(*keys), keys)
    twice = Window.partitionBy(*keys).orderBy("position")
    checked = placed.withColumn("_n", F.row_number().over(twice)).select(
        *keys, F.when(F.col("_n") == 1, F.floor(F.col("position") / batch_size)).otherwise(
            F.raise_error(F.lit("rows with the same hash and ties"))).alias("batch_id"))
    same = reduce(and_, [rows[k].eqNullSafe(checked[k]) for k in keys])
    return rows.join(checked, same).select(*[rows[c] for c in df.columns], "batch_id")
