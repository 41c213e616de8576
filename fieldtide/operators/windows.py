"""Windows over a series: start, slice, cap, buckets, padding, sweeps.

Each step is a narrow expression over the `images` array, so a sweep over any
number of windows or configurations needs no shuffle after the series exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.constants import (
    DAY_CLIP, DAYS_IN_SERIES, DAYS_PER_BUCKET, FRAMES_TO_CHECK, SERIES, SWEEP_CONFIGS,
    SWEEP_START_DAYS, buckets_in,
)
from fieldtide.functions import text, vectors
from fieldtide.operators import series as sr


@dataclass(frozen=True)
class WindowSpec:
    """Length of a window, width of a bucket, and the label look-back."""

    days: int = DAYS_IN_SERIES
    bucket: int = DAYS_PER_BUCKET
    frames: int = FRAMES_TO_CHECK

    @property
    def size(self) -> int:
        return buckets_in(self.days, self.bucket)


def _room(days: Column) -> Column:
    return F.col("last_day") - days


def start_early(days: Column) -> Column:
    return F.lit(0)


def start_mid(days: Column) -> Column:
    """Floor of half the spare days; negative when the series is shorter than the window."""
    return F.floor(_room(days) / 2).cast("int")


def start_late(days: Column) -> Column:
    return F.greatest(F.lit(0), _room(days))


def start_deterministic(days: Column) -> Column:
    """Hash of the day sum, spread over the spare days."""
    h = F.conv(F.substring(F.md5(F.col("day_sum").cast("string")), 1, 8), 16, 10).cast("bigint")
    return (h % 1000 % F.greatest(F.lit(1), _room(days))).cast("int")


def start_random(days: Column, seed: int = 42) -> Column:
    """Uniform start over the spare days, drawn by a seeded hash of the series key."""
    h = text.seeded_hash(
        F.col("bbox"), F.col("year"), text.micro_degrees(F.col("lon")),
        text.micro_degrees(F.col("lat")), F.col("CDL"), seed=seed)
    return (h % F.greatest(F.lit(1), _room(days))).cast("int")


STRATEGIES = {
    "early_season": start_early,
    "mid_season": start_mid,
    "late_season": start_late,
    "deterministic": start_deterministic,
    "random": start_random,
}


def window_start(strategy: str, days: int = DAYS_IN_SERIES) -> Column:
    """Start day by strategy name; an unknown name means deterministic."""
    return STRATEGIES.get(strategy, start_deterministic)(F.lit(days))


def window_start_by_name(strategy: Column, days: Column) -> Column:
    """Start day when the strategy and window length are columns of a sweep."""
    start = start_deterministic(days)
    for name in ("early_season", "mid_season", "late_season", "random"):
        start = F.when(strategy == name, STRATEGIES[name](days)).otherwise(start)
    return start


def slice_window(images: Column, start: Column, days: Column) -> Column:
    """Images with start <= day <= start + days, both ends included."""
    return F.filter(images, lambda o: (o["day"] >= start) & (o["day"] <= start + days))


def cap_first(kept: Column, size: Column) -> Column:
    """The first `size` images of a window, counted over all its images."""
    return F.filter(kept, lambda o: o["seq"] - kept[0]["seq"] < size)


def image_rank(day: Column, tile: Column, scl: Column, bands: Column, seed: int = 42) -> Column:
    """Seeded hash of an image that orders the images of a series at random."""
    values = F.array_join(bands.cast("array<string>"), ",")
    return text.seeded_hash(day, tile, scl, values, seed=seed)


def cap_random(kept: Column, size: Column, seed: int = 42) -> Column:
    """`size` images drawn by hash and put back in order (needs full series rows)."""
    ranked = F.sort_array(F.transform(kept, lambda o: F.struct(
        image_rank(o["day"], o["tile"], o["scl"], o["bands"], seed).alias("rank"),
        o["seq"].alias("seq"), o.alias("o"))))
    drawn = F.transform(F.slice(ranked, F.lit(1), size), lambda r: F.struct(
        r["seq"].alias("seq"), r["o"].alias("o")))
    return F.transform(F.sort_array(drawn), lambda r: r["o"])


def _relative(o: Column, kept: Column) -> Column:
    return F.greatest(F.lit(0), F.least(o["day"] - kept[0]["day"], F.lit(DAY_CLIP)))


def bucket_of(o: Column, kept: Column, width: Column) -> Column:
    return F.floor(_relative(o, kept) / width).cast("int")


def first_per_bucket(kept: Column, width: Column) -> Column:
    """First image of each tumbling bucket.

    Images are in day order, so an image opens its bucket exactly when its
    predecessor lies in another one.
    """
    opens = lambda o, i: (i == 0) | (
        bucket_of(o, kept, width) != bucket_of(F.get(kept, i - 1), kept, width))
    return F.transform(F.filter(kept, opens), lambda o: F.struct(
        bucket_of(o, kept, width).alias("bucket"), _relative(o, kept).alias("day"),
        o["scl"].alias("scl"), o["bands"].alias("bands")))


def cut(
    series: DataFrame,
    spec: WindowSpec | None = None,
    *,
    capped: bool = False,
    random_cap: bool = False,
) -> DataFrame:
    """Add `picks`: the bucketed images of the window that starts at `start_day`.

    Without a spec the window shape comes from the columns days_in_series and
    days_per_bucket (a configuration sweep).
    """
    if spec is not None:
        days, width, size = F.lit(spec.days), F.lit(spec.bucket), F.lit(spec.size)
    else:
        days, width = F.col("days_in_series"), F.col("days_per_bucket")
        size = F.floor(days / width).cast("int") + 1
    df = series.withColumn("kept", slice_window(F.col("images"), F.col("start_day"), days))
    if random_cap:
        df = df.withColumn("kept", cap_random(F.col("kept"), size))
    elif capped:
        df = df.withColumn("kept", cap_first(F.col("kept"), size))
    return df.withColumn("picks", first_per_bucket(F.col("kept"), width)).drop("kept")


def window_images(series: DataFrame, start: Column, days: Column) -> DataFrame:
    """Images of full series (build_series) with start <= day <= start + days, one row each."""
    kept = series.withColumn("images", slice_window(F.col("images"), start, days))
    return sr.explode_images(kept, *sr.KEYS)


def capped_images(
    series: DataFrame, start: Column, days: Column, size: int, seed: int | None = None,
) -> DataFrame:
    """At most `size` images of each window: the first ones, or a seeded draw.

    Counted over the whole series, however many rows it has; the rows of a series lie together
    already, so nothing is exchanged.
    """
    rows = window_images(series, start, days)
    if seed is None:
        first = F.min("seq").over(Window.partitionBy(*sr.KEYS))
        return rows.withColumn("_n", F.col("seq") - first).where(F.col("_n") < size).drop("_n")
    rank = image_rank(F.col("day"), F.col("tile"), F.col("scl"), F.col("bands"), seed)
    order = Window.partitionBy(*sr.KEYS).orderBy("_rank", "seq")
    return rows.withColumn("_rank", rank).withColumn("_n", F.row_number().over(order)).where(
        F.col("_n") <= size).drop("_rank", "_n")


def bucketed_images(series: DataFrame, start: Column, spec: WindowSpec) -> DataFrame:
    """Images of a window with their day from its first image and their bucket."""
    rows = window_images(series, start, F.lit(spec.days))
    first = F.min("day").over(Window.partitionBy(*sr.KEYS))
    rows = rows.withColumn("day", F.col("day") - first)
    clipped = F.greatest(F.lit(0), F.least(F.col("day"), F.lit(DAY_CLIP)))
    return rows.withColumn("bucket", F.floor(clipped / spec.bucket).cast("int"))


def cut_random(obs: DataFrame, spec: WindowSpec, seed: int = 42) -> DataFrame:
    """Random windows with at most `spec.size` random images, as series with `picks`.

    Images are ranked by hash inside their window; only the drawn ones are gathered. One exchange.
    """
    rows = sr._rows(obs)
    rows = rows.select("*", *sr.series_facts()).withColumn(
        "start_day", start_random(F.lit(spec.days), seed)).withColumn(
        "day", F.col("day") - F.col("first_day"))
    inside = (F.col("day") >= F.col("start_day")) & (F.col("day") <= F.col("start_day") + spec.days)
    rank = image_rank(F.col("day"), F.col("tile"), F.col("scl"), F.col("bands"), seed)
    order = Window.partitionBy(*sr.KEYS).orderBy(F.desc("_inside"), "_rank", "day", "tile", "bands", "scl")
    image = F.struct("day", "tile", "bands", "scl")
    drawn = (
        rows.withColumn("_inside", inside).withColumn("_rank", F.when(inside, rank))
        .withColumn("_n", F.row_number().over(order))
        .groupBy(*sr.KEYS)
        .agg(*[F.max(c).alias(c) for c in (*sr.FACTS, "start_day")],
             F.sort_array(F.collect_list(F.when(
                 F.col("_inside") & (F.col("_n") <= spec.size), image))).alias("kept"))
    )
    return drawn.withColumn("picks", first_per_bucket(F.col("kept"), F.lit(spec.bucket))).drop("kept", "series_id")


def slim(series: DataFrame) -> DataFrame:
    """Series without bands and tiles, enough for labels; sweeps copy far less."""
    return series.withColumn("images", F.transform("images", lambda o: F.struct(
        o["day"].alias("day"), o["seq"].alias("seq"), o["scl"].alias("scl"),
        F.array().cast("array<int>").alias("bands"))))


def sweep_start_days(series: DataFrame, days: Sequence[int] = SWEEP_START_DAYS) -> DataFrame:
    """Every series at every start day (the days are a literal, nothing is joined)."""
    return series.withColumn("start_day", F.explode(F.array(*map(F.lit, days))))


def sweep_configs(series: DataFrame, configs=SWEEP_CONFIGS) -> DataFrame:
    """Every series under every window configuration, with its start day."""
    rows = F.array(*[
        F.struct(F.lit(n).alias("config"), F.lit(d).alias("days_in_series"),
                 F.lit(b).alias("days_per_bucket"), F.lit(f).alias("frames_to_check"),
                 F.lit(s).alias("strategy"))
        for n, d, b, f, s in configs])
    swept = series.withColumn("c", F.explode(rows)).select("*", "c.*").drop("c")
    return swept.withColumn(
        "start_day", window_start_by_name(F.col("strategy"), F.col("days_in_series")))


def padded_rows(cut_series: DataFrame, spec: WindowSpec, *keep: str) -> DataFrame:
    """Bucketed matrix in long form: one row per bucket, zeros where it is empty."""
    by_bucket = F.map_from_entries(F.transform("picks", lambda p: F.struct(p["bucket"], p)))
    return (
        cut_series.select(
            *keep, by_bucket.alias("m"),
            F.explode(F.sequence(F.lit(0), F.lit(spec.size - 1))).alias("bucket"))
        .withColumn("p", F.try_element_at("m", F.col("bucket")))
        .select(*keep, "bucket", "p")
    )


def window_keys() -> list[str]:
    return [*SERIES, "start_day"]
