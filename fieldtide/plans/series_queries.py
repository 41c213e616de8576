"""Queries over series, windows, labels and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtide.constants import (
    BANDS, FRAMES_TO_CHECK, SERIES, SWEEP_CONFIGS, SWEEP_START_DAYS,
)
from fieldtide.functions import vectors
from fieldtide.operators import labels, quality, series as sr, windows as wn
from fieldtide.operators.windows import WindowSpec
from fieldtide.plans import oracle as o
from fieldtide.plans.registry import query
from fieldtide.sources import derived, tables

SPEC = WindowSpec()
WINDOW = [*SERIES, "start_day"]


def usable(obs: DataFrame) -> DataFrame:
    return quality.clean_numeric(quality.scl_mask(obs))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usable(derived.observations(spark, sf_dir))


def full_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.build_series(masked(spark, sf_dir))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.window_series(masked(spark, sf_dir))


def train_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.window_series(tables.drop_double_crops(masked(spark, sf_dir)))


def _labelled(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*WINDOW, *extra, F.size("picks").cast("bigint").alias("buckets"), "label")


_BANDS_TEXT = "concat_ws(',', " + ", ".join(f"{b}::VARCHAR" for b in BANDS) + ")"


def _bands_text(arr) -> F.Column:
    return F.array_join(F.transform(arr, lambda b: b.cast("string")), ",")


# --- building ----------------------------------------------------------------

@query("build_series", o.with_(*o.SERIES_CTES, select=f"""
SELECT {o.KEY}, num_images, min(scene_date) AS first_date,
  string_agg("day"::VARCHAR || ':' || tile || ':' || scl::VARCHAR || ':' || {_BANDS_TEXT}, ';' ORDER BY seq) AS images
FROM img GROUP BY ALL"""))
def build_series(spark, sf_dir):
    text = F.transform("images", lambda i: F.concat_ws(
        ":", i["day"].cast("string"), i["tile"], i["scl"].cast("string"), _bands_text(i["bands"])))
    return full_series(spark, sf_dir).select(
        *SERIES, "num_images", F.date_from_unix_date("first_day").alias("first_date"),
        F.array_join(text, ";").alias("images"))


@query("sort_series", o.with_(*o.SERIES_CTES, select=f"""
SELECT {o.KEY}, seq, scene_date, tile, scl, red, nir FROM img"""))
def sort_series(spark, sf_dir):
    rows = sr.explode_images(full_series(spark, sf_dir), *SERIES, "first_day")
    return rows.select(
        *SERIES, "seq", F.date_from_unix_date(F.col("first_day") + F.col("day")).alias("scene_date"),
        "tile", "scl", F.col("bands")[3].alias("red"), F.col("bands")[7].alias("nir"))


@query("relative_day", o.with_(*o.SERIES_CTES, select=f"""
SELECT {o.KEY}, string_agg("day"::VARCHAR, ',' ORDER BY seq) AS days FROM img GROUP BY ALL"""))
def relative_day(spark, sf_dir):
    rel = sr.relative_days(full_series(spark, sf_dir))
    return rel.withColumn("days", F.array_join(F.col("days").cast("array<string>"), ","))


@query("image_map", o.with_(*o.SERIES_CTES, select=f"""
SELECT {o.KEY}, seq, "day", scl, tile, {_BANDS_TEXT} AS "values" FROM img"""))
def image_map(spark, sf_dir):
    m = sr.image_map(full_series(spark, sf_dir))
    return m.select(*SERIES, F.explode("image_map").alias("seq", "v")).select(
        *SERIES, "seq", "v.day", "v.scl", "v.tile", _bands_text(F.col("v.values")).alias("values"))


@query("valid_series", o.with_(*o.SERIES_CTES, select=f"""
SELECT {o.KEY}, num_images FROM img GROUP BY ALL HAVING count(*) = num_images AND num_images > 0"""))
def valid_series(spark, sf_dir):
    return quality.valid_series(full_series(spark, sf_dir)).where("part = 0").select(*SERIES, "num_images")


@query("drop_double_crops", o.with_(o.OBS, o.MASKED, select=f"""
SELECT {o.KEY}, count(*) AS images FROM masked WHERE {o.NO_DOUBLE} GROUP BY ALL"""))
def drop_double_crops(spark, sf_dir):
    return tables.drop_double_crops(masked(spark, sf_dir)).groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("images"))


@query("ndvi_series", o.with_(o.OBS, o.MASKED, select=f"""
SELECT {o.KEY}, scene_date, tile, red, nir,
  round(CASE WHEN nir + red <> 0 THEN (nir - red)::DOUBLE/(nir + red) END, 6) AS ndvi FROM masked"""))
def ndvi_series(spark, sf_dir):
    return sr.ndvi_series(masked(spark, sf_dir)).withColumn("ndvi", F.round("ndvi", 6)).orderBy(
        *SERIES, "scene_date", "tile")


# --- windows -----------------------------------------------------------------

_STARTS = {
    "early_season": "0",
    "mid_season": "floor((last_day - 120)/2e0)",
    "late_season": "greatest(0, last_day - 120)",
    "deterministic": "('0x' || substr(md5(day_sum::VARCHAR), 1, 8))::BIGINT % 1000 % greatest(1, last_day - 120)",
    "random": """('0x' || substr(md5(concat_ws('|', '42', bbox, "year"::VARCHAR,
      round(lon*1000000)::BIGINT::VARCHAR, round(lat*1000000)::BIGINT::VARCHAR, CDL)), 1, 8))::BIGINT
      % greatest(1, last_day - 120)""",
}
#: Series-level facts: one row per series.
_FACTS = f"""facts AS (SELECT {o.KEY}, num_images, last_day, sum("day")::BIGINT AS day_sum FROM img GROUP BY ALL)"""
_IMG_SUM = f"""imgs AS (SELECT *, (sum("day") OVER (PARTITION BY {o.KEY}))::BIGINT AS day_sum FROM img)"""


@query("window_start", o.with_(*o.SERIES_CTES, _FACTS, select=" UNION ALL ".join(
    f"SELECT {o.KEY}, '{n}' AS strategy, ({e})::INTEGER AS start_day FROM facts"
    for n, e in _STARTS.items())))
def window_start(spark, sf_dir):
    starts = F.array(*[
        F.struct(F.lit(n).alias("strategy"), wn.window_start(n).cast("int").alias("start_day"))
        for n in _STARTS])
    return series(spark, sf_dir).select(*SERIES, F.inline(starts))


@query("window_slice", o.with_(*o.SERIES_CTES, *o.windows("30"), select=f"""
SELECT {o.KEY}, seq, "day", scl FROM kept"""))
def window_slice(spark, sf_dir):
    rows = wn.window_images(full_series(spark, sf_dir), F.lit(30), F.lit(SPEC.days))
    return rows.select(*SERIES, "seq", "day", "scl")


@query("cap_images", o.with_(*o.SERIES_CTES, *o.windows("0", days="180", cap="25"), select=f"""
SELECT {o.KEY}, seq, "day", scl FROM kept"""))
def cap_images(spark, sf_dir):
    rows = wn.capped_images(full_series(spark, sf_dir), F.lit(0), F.lit(180), 25)
    return rows.select(*SERIES, "seq", "day", "scl")


@query("cap_images_random", o.with_(*o.SERIES_CTES, *o.windows("0", days="180"), select=f"""
SELECT {o.KEY}, seq, "day", scl FROM kept QUALIFY row_number() OVER (PARTITION BY {o.KEY} ORDER BY {o.IMAGE_RANK}) <= 25"""))
def cap_images_random(spark, sf_dir):
    rows = wn.capped_images(full_series(spark, sf_dir), F.lit(0), F.lit(180), 25, seed=42)
    return rows.select(*SERIES, "seq", "day", "scl")


@query("bucketize", o.with_(*o.SERIES_CTES, *o.windows("15"), select=f"""
SELECT {o.KEY}, seq, rday AS "day", (rday // width)::INTEGER AS bucket FROM placed"""))
def bucketize(spark, sf_dir):
    rows = wn.bucketed_images(full_series(spark, sf_dir), F.lit(15), SPEC)
    return rows.select(*SERIES, "seq", "day", "bucket")


@query("first_per_bucket", o.with_(*o.SERIES_CTES, *o.windows("15"), select=f"""
SELECT {o.KEY}, bucket::INTEGER AS bucket, rday AS "day", scl, {_BANDS_TEXT} AS bands FROM picks"""))
def first_per_bucket(spark, sf_dir):
    s = wn.cut(series(spark, sf_dir).withColumn("start_day", F.lit(15)), SPEC)
    return s.select(*SERIES, F.inline(vectors.entries("picks"))).withColumn("bands", _bands_text(F.col("bands")))


@query("pad_buckets", o.with_(*o.SERIES_CTES, *o.windows("0"), f"""
grid AS (SELECT {o.KEY}, start_day, unnest(range(25)) AS bucket FROM labels)""", select=f"""
SELECT {o.KEY}, bucket::INTEGER AS bucket, coalesce(rday, 0) AS "day", coalesce(scl, 0) AS scl,
  {', '.join(f'coalesce({b}, 0) AS {b}' for b in BANDS)}
FROM grid LEFT JOIN picks USING ({o.KEY}, start_day, bucket)"""))
def pad_buckets(spark, sf_dir):
    s = wn.cut(series(spark, sf_dir).withColumn("start_day", F.lit(0)), SPEC)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return wn.padded_rows(s, SPEC, *SERIES).select(
        *SERIES, "bucket", zero(F.col("p.day")).alias("day"), zero(F.col("p.scl")).alias("scl"),
        *[zero(F.col("p.bands")[i]).alias(b) for i, b in enumerate(BANDS)])


# --- labels ------------------------------------------------------------------

@query("recent_vegetation", o.with_(*o.SERIES_CTES, *o.windows("60"), select=f"""
SELECT {o.KEY}, veg AS vegetation FROM labels"""))
def recent_vegetation(spark, sf_dir):
    s = wn.cut(wn.slim(series(spark, sf_dir)).withColumn("start_day", F.lit(60)), SPEC)
    return labels.label_windows(s, FRAMES_TO_CHECK).select(*SERIES, "vegetation")


@query("assign_label", o.with_(*o.SERIES_CTES, *o.windows("0"), select=f"""
SELECT {o.KEY}, start_day, buckets, label FROM labels"""))
def assign_label(spark, sf_dir):
    s = wn.cut(wn.slim(series(spark, sf_dir)).withColumn("start_day", F.lit(0)), SPEC)
    return _labelled(labels.label_windows(s, FRAMES_TO_CHECK))


# --- sweeps ------------------------------------------------------------------

_DAYS = ", ".join(map(str, SWEEP_START_DAYS))
_SWEPT = f"swept AS (SELECT *, unnest([{_DAYS}]) AS begin_day FROM img)"


@query("start_day_sweep", o.with_(
    *o.SERIES_CTES, _SWEPT, *o.windows("begin_day", source="swept"), select=f"""
SELECT {o.KEY}, start_day, buckets, label FROM labels"""))
def start_day_sweep(spark, sf_dir):
    return _labelled(swept_labels(spark, sf_dir))


def swept_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = wn.sweep_start_days(wn.slim(series(spark, sf_dir)))
    return labels.label_windows(wn.cut(s, SPEC), FRAMES_TO_CHECK)


def config_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = wn.sweep_configs(wn.slim(train_series(spark, sf_dir)))
    return labels.label_windows(wn.cut(s, capped=True), F.col("frames_to_check"))


_CONFIG_ROWS = ", ".join(f"('{n}', {d}, {b}, {f}, '{s}')" for n, d, b, f, s in SWEEP_CONFIGS)
_CONFIG_START = "CASE strategy " + " ".join(
    f"WHEN '{n}' THEN {e.replace('120', 'd')}" for n, e in _STARTS.items()) + " END"
CONFIG_CTES = [
    *o.SERIES_CTES, _IMG_SUM,
    f"configs AS (SELECT * FROM (VALUES {_CONFIG_ROWS}) t(config, d, b, f, strategy))",
    "swept AS (SELECT * FROM imgs, configs)",
    *o.windows(_CONFIG_START, days="d", bucket="b", frames="f", cap="span // width + 1",
               source="swept", extra="config", where=o.NO_DOUBLE),
]


@query("config_sweep", o.with_(*CONFIG_CTES, select=f"""
SELECT config, {o.KEY}, start_day, buckets, label FROM labels"""))
def config_sweep(spark, sf_dir):
    return _labelled(config_labels(spark, sf_dir), "config")
