"""From observations to one ordered series per pixel and year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.constants import SERIES
from fieldtide.functions import packing, spectral, vectors

#: Images in one row of a series at most. A pixel-year has some hundred images, so it is one row;
#: a longer series continues over further rows, whatever the size of the table.
ROW_IMAGES = 4096


#: Series keys as windows and groups use them. series_id is a hash of the others that rows are
#: dealt by: a later grouping by all keys then needs no exchange, as it would for bare doubles.
KEYS = ["series_id", *SERIES]


def _rows(obs: DataFrame) -> DataFrame:
    """Images dealt by series: the one exchange of every series plan."""
    return obs.select(
        *SERIES, F.xxhash64(*SERIES).alias("series_id"), F.unix_date("scene_date").alias("day"),
        "tile", vectors.band_array().alias("bands"), "scl",
    ).repartition("series_id")


def series_facts(weight: Column | None = None) -> list[Column]:
    """num_images, first_day, last_day and day_sum of the whole series, on every row of it."""
    whole = Window.partitionBy(*KEYS)
    weight = F.lit(1) if weight is None else weight
    first, images = F.min("day").over(whole), F.sum(weight).over(whole)
    return [
        images.cast("bigint").alias("num_images"), first.alias("first_day"),
        (F.max("day").over(whole) - first).alias("last_day"),
        (F.sum(F.col("day") * weight).over(whole) - images * first).cast("bigint").alias("day_sum"),
    ]


FACTS = ["num_images", "first_day", "last_day", "day_sum"]


def build_series(obs: DataFrame, per_row: int | None = None) -> DataFrame:
    """Every image of each (pixel, year), in order, with `num_images`.

    Row form: series key, series_id, part, num_images, first_day (epoch), last_day and day_sum (relative),
    images array<struct<day, seq, tile, bands, scl>>. Day, position and the facts always count
    from the whole series; row `part` holds the positions from part * per_row on. One exchange,
    one sort that can spill, and no group larger than per_row images is gathered.
    """
    per_row = per_row or ROW_IMAGES
    order = Window.partitionBy(*KEYS).orderBy("day", "tile", "bands", "scl")
    placed = _rows(obs).select("*", (F.row_number().over(order) - 1).cast("bigint").alias("seq"))
    placed = placed.select(*KEYS, "seq", "day", "tile", "bands", "scl", *series_facts())
    image = F.struct((F.col("day") - F.col("first_day")).alias("day"), "seq", "tile", "bands", "scl")
    gathered = placed.groupBy(*KEYS, F.floor(F.col("seq") / per_row).alias("part")).agg(
        *[F.max(c).alias(c) for c in FACTS], F.sort_array(F.collect_list(image)).alias("images"))
    return gathered.select(*SERIES, "series_id", "part", *FACTS, "images")


def window_series(obs: DataFrame) -> DataFrame:
    """Series as the window operators need them, one row per (pixel, year).

    Windows, buckets and caps only look at the first image of a day and at how many images came
    before it, so a row holds one image per day, 366 at most; `seq` still counts all images.
    """
    days = _rows(obs).groupBy(*KEYS, "day").agg(
        F.min(F.struct("tile", "bands", "scl")).alias("top"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*KEYS).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    placed = days.select(
        *KEYS, "day", "top", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq"),
        *series_facts(F.col("n")))
    image = F.struct(
        (F.col("day") - F.col("first_day")).alias("day"), "seq", F.col("top.tile").alias("tile"),
        F.col("top.bands").alias("bands"), F.col("top.scl").alias("scl"))
    return placed.groupBy(*KEYS).agg(
        *[F.max(c).alias(c) for c in FACTS], F.sort_array(F.collect_list(image)).alias("images")
    ).select(*SERIES, *FACTS, "images")


def explode_images(series: DataFrame, *keep: str) -> DataFrame:
    """One row per image of a series: position, day, tile, mask class and bands."""
    return series.select(*keep, F.explode(vectors.entries("images")).alias("o")).select(*keep, "o.*")


def image_map(series: DataFrame) -> DataFrame:
    """Series as a map from image position to (day, values, scl, tile)."""
    entry = lambda o: F.struct(
        o["seq"], F.struct(o["day"].alias("day"), o["bands"].alias("values"),
                           o["scl"].alias("scl"), o["tile"].alias("tile")))
    return series.select(
        *SERIES, F.map_from_entries(F.transform("images", entry)).alias("image_map"))


def relative_days(series: DataFrame) -> DataFrame:
    """Day of every image counted from the first image of its series."""
    return series.select(*SERIES, F.transform("images", lambda o: o["day"]).alias("days"))


def ndvi_series(obs: DataFrame) -> DataFrame:
    """Vegetation index of every observation, null where both bands are zero."""
    return obs.select(
        *SERIES, "scene_date", "tile", "red", "nir",
        spectral.ndvi(F.col("red"), F.col("nir")).alias("ndvi"))


PACKED_FACTS = ["part", "first_seq", "series_images", "first_day", "last_day", "day_sum"]


def pack_series(series: DataFrame) -> DataFrame:
    """Binary interop form, one row per series row; num_images counts the images of the row.

    The facts of the whole series and the position of the row in it follow as further columns.
    """
    images, first = F.col("images"), F.col("first_day")
    words = F.flatten(F.transform(images, lambda o: o["bands"]))
    return series.select(
        "lon", "lat", F.size(images).cast("bigint").alias("num_images"),
        packing.pack_words(words, "band value").alias("bands"),
        packing.pack_words(F.transform(images, lambda o: o["day"] + first), "image day")
        .alias("img_dates"),
        packing.pack_bytes(F.transform(images, lambda o: o["scl"]), "mask class").alias("scl_vals"),
        packing.encode_text(F.array_join(F.transform(images, lambda o: o["tile"]), ","))
        .alias("tiles"),
        packing.encode_text(F.col("CDL")).alias("CDL"),
        "part", images[0]["seq"].alias("first_seq"), F.col("num_images").alias("series_images"),
        "first_day", "last_day", "day_sum", "bbox", "year",
    )


def unpack_series(packed: DataFrame) -> DataFrame:
    """Inverse of pack_series: typed series in the row form of build_series.

    A packed table without the series facts (from another writer) holds one row per series, and
    the facts are those of the row.
    """
    for name in PACKED_FACTS:
        if name not in packed.columns:
            packed = packed.withColumn(name, F.lit(None).cast("bigint"))
    parts = packed.select(
        "bbox", "year", "lon", "lat", packing.decode_text(F.col("CDL")).alias("CDL"), "num_images",
        *PACKED_FACTS,
        packing.unpack_words(F.col("img_dates")).alias("days"),
        F.split(packing.decode_text(F.col("tiles")), ",").alias("tiles"),
        packing.unpack_rows(F.col("bands")).alias("rows"),
        packing.unpack_bytes(F.col("scl_vals")).alias("scls"),
    ).withColumn("first_day", F.coalesce("first_day", F.col("days")[0]).cast("int"))
    zipped, base = F.arrays_zip("days", "tiles", "rows", "scls"), F.coalesce("first_seq", F.lit(0))
    own_sum = F.aggregate("days", F.lit(0).cast("bigint"), lambda a, d: a + d - F.col("first_day"))
    return parts.select(
        *SERIES, F.xxhash64(*SERIES).alias("series_id"),
        F.coalesce("part", F.lit(0)).cast("bigint").alias("part"),
        F.coalesce("series_images", "num_images").alias("num_images"), "first_day",
        F.coalesce("last_day", F.array_max("days") - F.col("first_day")).cast("int").alias("last_day"),
        F.coalesce("day_sum", own_sum).cast("bigint").alias("day_sum"),
        F.transform(zipped, lambda z, i: F.struct(
            (z["days"] - F.col("first_day")).alias("day"), (base + i).cast("bigint").alias("seq"),
            z["tiles"].alias("tile"), z["rows"].alias("bands"), z["scls"].alias("scl")))
        .alias("images"),
    )
