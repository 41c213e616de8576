"""Row-level quality: masks, cleaning, validity, scene health."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtide.constants import ASSETS, BANDS, CHANNELS, SCENE, SCL_DROP, SERIES


def scl_mask(obs: DataFrame, drop: list[int] = SCL_DROP) -> DataFrame:
    """Keep observations whose scene class is usable; runs before anything wider."""
    return obs.where(~F.col("scl").isin(drop))


def clean_numeric(obs: DataFrame) -> DataFrame:
    """Infinite and NaN assets become null, rows with any null go, the rest become ints."""
    types = {f.name: f.dataType for f in obs.schema}

    def finite(name: str) -> str:
        if isinstance(types[name], (T.DoubleType, T.FloatType)):
            return f"not isnan(`{name}`) and abs(`{name}`) != double('infinity')"
        return f"`{name}` is not null"

    def whole(name: str) -> str:
        if name in ASSETS and types[name] != T.IntegerType():
            return f"cast(`{name}` as int) as `{name}`"
        return f"`{name}`"

    # One predicate per column, on the stored columns: each can reach the scan,
    # and the optimizer does not have to carry one wide expression around.
    return obs.where(" and ".join(map(finite, obs.columns))).selectExpr(*map(whole, obs.columns))


def valid_series(series: DataFrame) -> DataFrame:
    """Series with at least one image whose rows together hold what num_images says."""
    held = F.sum(F.size("images")).over(Window.partitionBy("series_id", *SERIES))
    return series.withColumn("_held", held).where(
        (F.col("num_images") > 0) & (F.col("_held") == F.col("num_images"))).drop("_held")


def valid_packed(packed: DataFrame) -> DataFrame:
    """Packed series whose blob lengths agree with num_images."""
    n = F.col("num_images")
    return packed.where(
        (n > 0)
        & (F.length("bands") == n * 2 * len(BANDS))
        & (F.length("img_dates") == n * 2)
        & (F.length("scl_vals") == n))


def dead_assets(obs: DataFrame) -> DataFrame:
    """Per scene: points and how many assets have no value at all (null or NaN)."""
    live = [F.count(F.nanvl(F.col(a).cast("double"), F.lit(None).cast("double"))).alias(a)
            for a in ASSETS]
    dead = sum((F.when(F.col(a) == 0, 1).otherwise(0) for a in ASSETS), F.lit(0))
    return (
        obs.groupBy(*SCENE).agg(F.count(F.lit(1)).alias("points"), *live)
        .select(*SCENE, "points", dead.alias("dead_assets"))
    )


def scene_asset_health(obs: DataFrame) -> DataFrame:
    """Scenes fit for use: at most half of their assets are entirely null."""
    return dead_assets(obs).where(F.col("dead_assets") <= len(ASSETS) * 0.5)


def assemble_assets(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Sampled assets side by side on (pixel, scene).

    One aggregate for all assets: the samples of a scene meet before the shuffle, which carries
    one row for a pixel and scene. (A pivot groups by key and asset first and shuffles each sample.)
    """
    return samples.groupBy(*keys).agg(*[
        F.max(F.when(F.col("asset") == a, F.col("value"))).alias(a) for a in ASSETS])


def unpadded_rows(rows: DataFrame, normalised: bool) -> DataFrame:
    """Feature rows without padding.

    Normalised rows are de-duplicated (all padding collapses into one row); raw
    rows are kept when no channel is zero.
    """
    if normalised:
        return rows.select(*CHANNELS).dropDuplicates()
    full = F.col(CHANNELS[0]) != 0
    for name in CHANNELS[1:]:
        full = full & (F.col(name) != 0)
    return rows.where(full)
