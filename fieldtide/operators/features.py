"""Features of windows: index channels, normalisation, training and test examples."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtide.constants import (
    BANDS, CHANNELS, DAY_CLIP, INDICES, LEGEND, NO_CROP, SCL_VEGETATION, UNCULTIVATED,
)
from fieldtide.functions import spectral, vectors
from fieldtide.functions.spectral import EPS
from fieldtide.operators import labels, windows as wn
from fieldtide.operators.windows import WindowSpec

# Executors get the functions of this module with the task, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Band positions the index channels read.
BLUE, RED, NIR, SWIR = (BANDS.index(b) for b in ("blue", "red", "nir", "swir16"))


def channels_of(bands: Column, num_features: int = len(CHANNELS)) -> Column:
    """Matrix row of one image: twelve bands, with the four indices unless only bands are asked."""
    row = F.transform(bands, lambda b: b.cast("bigint"))
    if num_features == len(BANDS):
        return row
    return F.concat(row, F.array(*spectral.index_columns(
        bands[BLUE], bands[RED], bands[NIR], bands[SWIR])))


def pick_rows(cut_series: DataFrame, *keep: str) -> DataFrame:
    """Long form of the filled buckets, one flat column per channel.

    Empty buckets hold only zeros, which every consumer masks out, so they are
    not generated at all.
    """
    rows = cut_series.select(*keep, F.explode(vectors.entries("picks")).alias("p")).select(
        *keep, "p.bucket", "p.day", "p.scl",
        *[F.col("p.bands")[i].alias(b) for i, b in enumerate(BANDS)])
    index = spectral.index_columns(F.col("blue"), F.col("red"), F.col("nir"), F.col("swir16"))
    return rows.select("*", *[c.alias(n) for c, n in zip(index, INDICES)])


def norm_stats(rows: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Mean and population deviation of the non-zero values of each channel.

    All channels are aggregated in one pass over the rows (one partial result per
    task) and turned into (channel, mean, std) afterwards.
    """
    aggs = []
    for c in channels:
        seen = F.when(F.col(c) != 0, F.col(c).cast("double"))
        aggs += [F.avg(seen).alias(f"{c}_mean"), F.stddev_pop(seen).alias(f"{c}_std")]
    table = F.array(*[
        F.struct(F.lit(i).alias("channel"), F.lit(c).alias("name"),
                 F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std"))
        for i, c in enumerate(channels)])
    return rows.agg(*aggs).select(F.inline(table))


def norm_stats_compacted(rows: DataFrame) -> DataFrame:
    """Statistics by position after zeros are squeezed out of each row.

    A zero shifts later channels to the left; bands and indices are squeezed
    separately. This is what a ragged mask computes.
    """
    def squeezed(names: Sequence[str], offset: int) -> Column:
        values = F.filter(F.array(*[F.col(c).cast("double") for c in names]), lambda x: x != 0)
        return F.transform(values, lambda x, i: F.struct(
            (i + offset).alias("channel"), x.alias("x")))

    both = F.concat(squeezed(BANDS, 0), squeezed(INDICES, len(BANDS)))
    return rows.select(F.inline(both)).groupBy("channel").agg(
        F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def stats_array(stats: DataFrame) -> Column:
    """Statistics as one scalar subquery (array of 12 or 16 entries in channel order)."""
    entry = F.struct("channel", "mean", "std")
    return stats.agg(F.sort_array(F.collect_list(entry)).alias("s")).scalar()


def _row_features(bands: Column, num_features: int, stats: str | None) -> Column:
    row = channels_of(bands, num_features)
    if stats is None:
        return F.transform(row, lambda x: x.cast("double"))
    return F.transform(row, lambda x, i: vectors.zscore(
        x.cast("double"), F.col(stats)[i]["mean"], F.col(stats)[i]["std"]).cast("float"))


def flat_features(
    spec: WindowSpec, num_features: int = len(CHANNELS), stats: str | None = None,
) -> Column:
    """Padded matrix of `picks` as one flat array (bucket-major).

    Raw values are doubles: the enhanced index has no bound, and a float keeps whole numbers up to
    2^24 only. Normalised values are floats.
    Only filled buckets are computed; the gaps before, between and after them are
    filled with zeros in place.
    """
    zeros = F.array_repeat(F.lit(0.0).cast("double" if stats is None else "float"), num_features)
    by_bucket = F.map_from_entries(F.transform("picks", lambda p: F.struct(
        p["bucket"], _row_features(p["bands"], num_features, stats))))
    slots = F.sequence(F.lit(0), F.lit(spec.size - 1))
    return vectors.let(by_bucket, lambda filled: F.flatten(F.transform(
        slots, lambda b: F.coalesce(F.try_element_at(filled, b), zeros))))


def make_examples(
    series: DataFrame,
    spec: WindowSpec,
    stats: DataFrame | None = None,
    *,
    start_day: Column | None = None,
    strategy: str = "deterministic",
    num_features: int = len(CHANNELS),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Series to (features, label, one_hot).

    With a start_day (column) this is the test form: every image in the window is
    used. Without one the strategy picks the window and the image cap of the
    training form applies. Windows that were cut before (random ones, by
    windows.cut_random) are taken as they are.
    """
    if "picks" in series.columns:
        df = series
    elif start_day is not None:
        df = wn.cut(series.withColumn("start_day", start_day), spec)
    elif strategy == "random":
        raise ValueError("random windows are drawn from observations: use windows.cut_random")
    else:
        df = wn.cut(series.withColumn("start_day", wn.window_start(strategy, spec.days)),
                    spec, capped=True)
    df = labels.label_windows(df, spec.frames)
    name = None
    if stats is not None:
        name = "stats"
        df = df.withColumn(name, stats_array(stats))
    features = flat_features(spec, num_features, name)
    return df.select(
        *keep, "start_day", features.alias("features"), "label",
        vectors.one_hot(F.col("label"), len(LEGEND)).alias("one_hot"))


def _picked(day, owner, start: int, days: int, width: int):
    """Images (positions) that open a bucket of the window, with their bucket; as windows.cut."""
    import numpy as np

    at = np.flatnonzero((day >= start) & (day <= start + days))
    who = owner[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = who[1:] != who[:-1]
    first = day[at][new][np.cumsum(new) - 1]
    bucket = np.clip(day[at] - first, 0, DAY_CLIP) // width
    new[1:] |= bucket[1:] != bucket[:-1]
    return at[new], bucket[new]


def _channel_rows(bands, stats):
    """Channels of every image, raw or normalised; the arithmetic of functions.spectral."""
    import numpy as np

    blue, red, nir, swir = (bands[:, i].astype("float64") for i in (BLUE, RED, NIR, SWIR))
    eps = EPS
    index = [np.clip((nir - red) / (nir + red + eps), -1.0, 1.0),
             (nir - red) * 2.5 / (nir + red * 6 - blue * 7.5 + 1 + eps),
             (nir - swir) / (nir + swir + eps), (swir - nir) / (swir + nir + eps)]
    rows = np.column_stack([bands, *[np.trunc(x * 100) for x in index]]).astype("float64")
    if stats is None:
        return rows + 0.0
    mean, std = stats
    with np.errstate(divide="raise"):
        return np.divide(rows - mean, std, out=np.zeros_like(rows), where=rows != 0).astype("float32")


def _no_crop(who, scl, n: int, frames: int):
    """Windows whose last `frames` buckets with a mask class show no vegetation, of those that have any."""
    import numpy as np

    who, scl = who[scl != 0], scl[scl != 0]
    held = np.bincount(who, minlength=n)
    left = np.cumsum(held)[who] - np.arange(len(who))  # 1 for the last of a window
    green = np.zeros(n, dtype=bool)
    green[who[(left <= frames) & (scl == SCL_VEGETATION)]] = True
    return (held > 0) & ~green


def swept_examples(
    series: DataFrame, spec: WindowSpec, days: Sequence[int], keep: Sequence[str],
    stats: DataFrame | None = None,
) -> DataFrame:
    """The rows of `make_examples` for every series at every start day, cut in Arrow batches.

    The channels of an image are computed once for all windows, and a window costs a few array
    operations for a whole batch of series; expressions over arrays are interpreted element by
    element in Spark. stats: (channel, mean, std), 16 rows, collected. Bands must not be null.
    """
    days = list(days)
    scale = None
    if stats is not None:
        table = sorted((r["channel"], r["mean"], r["std"]) for r in stats.collect())
        scale = [[float("nan") if r[k] is None else r[k] for r in table] for k in (1, 2)]
    kind = T.DoubleType() if stats is None else T.FloatType()
    schema = series.select(*keep).schema.add("start_day", T.IntegerType()).add(
        "features", T.ArrayType(kind)).add("label", T.IntegerType())
    # plain numbers: a task has no copy of the package
    size, width, length, bucket_days, frames = spec.size, len(CHANNELS), spec.days, spec.bucket, spec.frames

    def cut(records):
        import numpy as np
        import pyarrow as pa

        for record in records:
            n, first = record.num_rows, len(keep)
            if not n:
                continue
            base, day, scl, bands = record.columns[first:]
            owner = np.repeat(np.arange(n), np.diff(day.offsets.to_numpy()))
            day, scl, base = day.flatten().to_numpy(), scl.flatten().to_numpy(), base.to_numpy()
            rows = _channel_rows(bands.flatten().to_numpy().reshape(len(day), len(BANDS)), scale)
            ends = pa.array(np.arange(n + 1, dtype="int32") * (size * width))
            for start in days:
                at, bucket = _picked(day, owner, start, length, bucket_days)
                matrix = np.zeros((n, size, width), dtype=rows.dtype)
                matrix[owner[at], bucket] = rows[at]
                label = np.where((base != UNCULTIVATED) & _no_crop(owner[at], scl[at], n, frames), NO_CROP, base)
                yield pa.RecordBatch.from_arrays(
                    [*record.columns[:first], pa.array(np.full(n, start, dtype="int32")),
                     pa.ListArray.from_arrays(ends, pa.array(matrix.ravel())), pa.array(label.astype("int32"))],
                    [*keep, "start_day", "features", "label"])

    plain = series.select(
        *keep, labels.base_label(F.col("CDL")).cast("int").alias("_base"), F.col("images.day").alias("_days"),
        F.col("images.scl").alias("_scl"), F.flatten("images.bands").alias("_bands"))
    return plain.mapInArrow(cut, schema).withColumn("one_hot", vectors.one_hot(F.col("label"), len(LEGEND)))


def value_counts(rows: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """(channel, value, n) of the non-zero values; shrinks before the shuffle."""
    table = F.array(*[
        F.struct(F.lit(i).alias("channel"), F.col(c).cast("bigint").alias("value"))
        for i, c in enumerate(channels)])
    return (
        rows.select(F.inline(table)).where(F.col("value") != 0)
        .groupBy("channel", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def feature_profile(rows: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Exact five-number summary per channel, raw and normalised, padding removed.

    Value frequencies are counted once; their sums by bins of 256 neighbouring values say in which
    bin a rank lies, and running counts inside a bin give each value its ranks. So no task holds
    the values of a channel, only its bins; both levels read the same exchange. Normalising is
    linear and increasing: the quantiles of the normalised values are the normalised quantiles.
    """
    value = F.col("value").cast("double")
    # said here, so that the join below adds no filter to one of the two uses of this exchange
    counts = value_counts(rows, channels).withColumn("_bin", F.shiftright("value", 8)).where(
        F.col("channel").isNotNull() & F.col("_bin").isNotNull())
    channel = Window.partitionBy("channel")
    earlier = channel.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = counts.groupBy("channel", "_bin").agg(
        F.sum("n").alias("_m"), F.sum(value * F.col("n")).alias("_sum"),
        F.min(value).alias("_least"), F.max(value).alias("_most"),
    ).select(
        "channel", "_bin", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_m").over(channel).alias("count"), (F.sum("_sum").over(channel) / F.sum("_m").over(channel)).alias("mean"),
        F.min("_least").over(channel).alias("min"), F.max("_most").over(channel).alias("max"))
    running = Window.partitionBy("channel", "_bin").orderBy("value")
    ranked = (
        counts.withColumn("_upto", F.sum("n").over(running)).join(bins, ["channel", "_bin"])
        .withColumn("_end", F.col("_before") + F.col("_upto")))
    last = F.col("count") - 1

    def at(rank: Column) -> Column:
        """The value that holds a zero-based rank."""
        return F.max(F.when((F.col("_end") - F.col("n") <= rank) & (rank < F.col("_end")), value))

    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    picked = ranked.groupBy("channel", "count", "mean", "min", "max").agg(
        F.sqrt(F.sum(F.col("n") * F.pow(value - F.col("mean"), F.lit(2))) / F.max("count")).alias("std"),
        *[at(F.floor(last * s)).alias(f"{k}_low") for k, s in shares.items()],
        *[at(F.ceil(last * s)).alias(f"{k}_high") for k, s in shares.items()])
    between = lambda k, s: F.col(f"{k}_low") + (
        F.col(f"{k}_high") - F.col(f"{k}_low")) * (last * s - F.floor(last * s))
    raw = picked.select("channel", "count", "mean", "std", "min", "max",
                        *[between(k, s).alias(k) for k, s in shares.items()])
    z = lambda c: ((F.col(c) - F.col("mean")) / F.col("std")).alias(f"z_{c}")
    five = ["min", "q1", "median", "q3", "max"]
    return raw.select("channel", "count", *five, *map(z, five))
