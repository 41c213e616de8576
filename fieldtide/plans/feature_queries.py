"""Queries over features: indices, statistics, examples, class balance, configuration reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtide.constants import (
    BANDS, CHANNELS, FRAMES_TO_CHECK, IMBALANCE_SHARE, INDICES, LEGEND, SCL_NAMES, SERIES,
    SWEEP_START_DAYS,
)
from fieldtide.functions import packing, spectral, text, vectors
from fieldtide.operators import features as ft, labels, quality, sampling, sweeps, windows as wn
from fieldtide.operators import series as sr
from fieldtide.plans import oracle as o
from fieldtide.plans.registry import ORACLES, query
from fieldtide.sources import derived, tables
from fieldtide.plans.series_queries import (
    CONFIG_CTES, SPEC, _STARTS, config_labels, full_series, masked, series, swept_labels, train_series,
)

_CTES = [*o.SERIES_CTES]
_TRAIN0 = o.windows("0", where=o.NO_DOUBLE)


def _r(c, digits: int = 6):
    return F.round(c, digits)


def train_window(spark, sf_dir):
    """Training series cut at start day 0 without the image cap (the statistics window)."""
    return wn.cut(train_series(spark, sf_dir).withColumn("start_day", F.lit(0)), SPEC)


def train_rows(spark, sf_dir):
    return ft.pick_rows(train_window(spark, sf_dir), *SERIES)


# --- scalar functions --------------------------------------------------------

@query("spectral_indices", o.with_(o.OBS, o.MASKED, select=f"""
SELECT {o.KEY}, scene_date, tile, blue, red, nir, swir16, {o.INDEX_LIST} FROM masked"""))
def spectral_indices(spark, sf_dir):
    index = spectral.index_columns(F.col("blue"), F.col("red"), F.col("nir"), F.col("swir16"))
    return masked(spark, sf_dir).select(
        *SERIES, "scene_date", "tile", "blue", "red", "nir", "swir16",
        *[c.alias(n) for c, n in zip(index, INDICES)])


@query("ndvi_nullsafe", o.with_(o.OBS, select="""
SELECT "year", CDL, count(*) AS images, count(CASE WHEN nir + red <> 0 THEN 1 END) AS defined,
  round(avg(CASE WHEN nir + red <> 0 THEN (nir - red)::DOUBLE/(nir + red) END), 6) AS mean_ndvi
FROM obs GROUP BY ALL"""))
def ndvi_nullsafe(spark, sf_dir):
    v = spectral.ndvi(F.col("red"), F.col("nir"))
    return derived.observations(spark, sf_dir).groupBy("year", "CDL").agg(
        F.count(F.lit(1)).alias("images"), F.count(v).alias("defined"),
        _r(F.avg(v)).alias("mean_ndvi"))


@query("ndvi_array", o.with_(*_CTES, select=f"""
SELECT {o.KEY}, num_images, count(*) FILTER (nir + red <> 0) AS images,
  string_agg(trunc((nir - red)::DOUBLE/(nir + red)*10000)::INTEGER::VARCHAR, ',' ORDER BY seq)
    FILTER (nir + red <> 0) AS ndvi
FROM img GROUP BY ALL"""))
def ndvi_array(spark, sf_dir):
    s = full_series(spark, sf_dir).withColumn("v", spectral.ndvi_array(F.col("images")))
    return s.select(
        *SERIES, "num_images", F.size("v").cast("bigint").alias("images"),
        F.array_join(F.transform("v", lambda x: (x * 10000).cast("int").cast("string")), ",")
        .alias("ndvi"))


@query("epoch_day", o.with_(o.OBS, select="""
SELECT scene_date, (scene_date - DATE '1970-01-01')::INTEGER AS epoch_day, count(*) AS images
FROM obs GROUP BY ALL"""))
def epoch_day(spark, sf_dir):
    return derived.observations(spark, sf_dir).groupBy(
        "scene_date", packing.epoch_day(F.col("scene_date")).alias("epoch_day")).agg(
        F.count(F.lit(1)).alias("images"))


@query("one_hot", o.with_(*_CTES, *o.windows("0"), select=f"""
SELECT {o.KEY}, label, array_to_string([CASE WHEN i = label THEN 1 ELSE 0 END FOR i IN range(7)], ',') AS one_hot,
  label AS decoded FROM labels"""))
def one_hot(spark, sf_dir):
    s = wn.cut(wn.slim(series(spark, sf_dir)).withColumn("start_day", F.lit(0)), SPEC)
    rows = labels.label_windows(s, FRAMES_TO_CHECK).withColumn(
        "v", vectors.one_hot(F.col("label"), len(LEGEND)))
    return rows.select(
        *SERIES, "label", F.array_join(F.col("v").cast("array<string>"), ",").alias("one_hot"),
        vectors.argmax(F.col("v")).alias("decoded"))


@query("wide_to_vector", o.with_(o.OBS, o.MASKED, select=f"""
SELECT {o.KEY}, scene_date, tile, concat_ws(',', {', '.join(f'{b}::VARCHAR' for b in BANDS)}) AS bands,
  scl FROM masked"""))
def wide_to_vector(spark, sf_dir):
    return masked(spark, sf_dir).select(
        *SERIES, "scene_date", "tile",
        F.array_join(vectors.band_array().cast("array<string>"), ",").alias("bands"), "scl")


@query("pack_series", o.with_(*_CTES, select=f"""
SELECT lon, lat, num_images,
  string_agg(concat({', '.join(f"printf('%04X', {b})" for b in BANDS)}), '' ORDER BY seq) AS bands,
  string_agg(printf('%04X', first_day + "day"), '' ORDER BY seq) AS img_dates,
  string_agg(printf('%02X', scl), '' ORDER BY seq) AS scl_vals,
  string_agg(tile, ',' ORDER BY seq) AS tiles, CDL, bbox, "year"
FROM img GROUP BY lon, lat, num_images, CDL, bbox, "year" """))
def pack_series(spark, sf_dir):
    p = quality.valid_packed(sr.pack_series(full_series(spark, sf_dir)))
    return p.select(
        "lon", "lat", "num_images", F.hex("bands").alias("bands"),
        F.hex("img_dates").alias("img_dates"), F.hex("scl_vals").alias("scl_vals"),
        packing.decode_text(F.col("tiles")).alias("tiles"),
        packing.decode_text(F.col("CDL")).alias("CDL"), "bbox", "year")


@query("unpack_series", o.with_(*_CTES, select=f"""
SELECT {o.KEY}, seq, "day", tile, scl, {o.BAND_LIST} FROM img"""))
def unpack_series(spark, sf_dir):
    back = sr.unpack_series(sr.pack_series(full_series(spark, sf_dir)))
    return sr.explode_images(back, *SERIES).select(
        *SERIES, "seq", "day", "tile", "scl",
        *[F.col("bands")[i].alias(b) for i, b in enumerate(BANDS)])


@query("decode_text", o.with_(o.OBS, select="""
SELECT CDL, octet_length(encode(CDL)) AS bytes, count(*) AS images FROM obs GROUP BY ALL"""))
def decode_text(spark, sf_dir):
    blob = packing.encode_text(F.col("CDL"))
    return (
        derived.observations(spark, sf_dir).select(blob.alias("blob"))
        .groupBy(packing.decode_text(F.col("blob")).alias("CDL"),
                 F.octet_length("blob").cast("bigint").alias("bytes"))
        .agg(F.count(F.lit(1)).alias("images")))


_SCL_CASE = "CASE scl " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in SCL_NAMES.items()) + " END"


@query("scl_names", o.with_(o.OBS, select=f"""
SELECT scl, {_SCL_CASE} AS name, count(*) AS images FROM obs GROUP BY ALL"""))
def scl_names(spark, sf_dir):
    return derived.observations(spark, sf_dir).groupBy(
        "scl", text.scl_name(F.col("scl")).alias("name")).agg(F.count(F.lit(1)).alias("images"))


# --- statistics --------------------------------------------------------------

_ROWS = f"rows_ AS (SELECT *, {o.INDEX_LIST} FROM picks)"


def _stats_sql(channels) -> str:
    return " UNION ALL ".join(
        f"SELECT {i}::INTEGER AS channel, '{c}' AS name, round(avg({c}::DOUBLE) FILTER ({c} <> 0), 6) AS mean, "
        f"round(stddev_pop({c}::DOUBLE) FILTER ({c} <> 0), 6) AS std FROM rows_"
        for i, c in enumerate(channels))


@query("norm_stats", o.with_(*_CTES, *_TRAIN0, _ROWS, select=_stats_sql(CHANNELS)))
def norm_stats(spark, sf_dir):
    st = ft.norm_stats(train_rows(spark, sf_dir))
    return st.select("channel", "name", _r("mean").alias("mean"), _r("std").alias("std"))


@query("norm_stats_bands", o.with_(*_CTES, *_TRAIN0, _ROWS, select=_stats_sql(BANDS)))
def norm_stats_bands(spark, sf_dir):
    st = ft.norm_stats(train_rows(spark, sf_dir), BANDS)
    return st.select("channel", "name", _r("mean").alias("mean"), _r("std").alias("std"))


@query("norm_stats_compacted", o.with_(*_CTES, *_TRAIN0, _ROWS, f"""
flat AS (SELECT list_filter([{', '.join(f'{b}::DOUBLE' for b in BANDS)}], lambda x: x <> 0) AS b,
  list_filter([{', '.join(f'{b}::DOUBLE' for b in INDICES)}], lambda x: x <> 0) AS i FROM rows_)""", """
longer AS (SELECT unnest(b) AS x, unnest(range(len(b))) AS channel FROM flat
  UNION ALL SELECT unnest(i), unnest(range(12, 12 + len(i))) FROM flat)""", select="""
SELECT channel::INTEGER AS channel, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
FROM longer GROUP BY channel"""))
def norm_stats_compacted(spark, sf_dir):
    st = ft.norm_stats_compacted(train_rows(spark, sf_dir))
    return st.select("channel", _r("mean").alias("mean"), _r("std").alias("std"))


@query("feature_profile", o.with_(*_CTES, *_TRAIN0, _ROWS, f"""
vals AS (UNPIVOT (SELECT {', '.join(f'{c}::BIGINT AS {c}' for c in CHANNELS)} FROM rows_)
  ON {', '.join(CHANNELS)} INTO NAME channel_name VALUE v)""", f"""
prof AS (SELECT (list_position({o.strings(CHANNELS)}, channel_name) - 1)::INTEGER AS channel, count(*) AS n,
  min(v)::DOUBLE AS lo, quantile_cont(v, 0.25)::DOUBLE AS q1, quantile_cont(v, 0.5)::DOUBLE AS q2,
  quantile_cont(v, 0.75)::DOUBLE AS q3, max(v)::DOUBLE AS hi, avg(v::DOUBLE) AS m, stddev_pop(v::DOUBLE) AS s
  FROM vals WHERE v <> 0 GROUP BY channel_name)""", select="""
SELECT channel, n AS count, lo AS "min", q1, q2 AS median, q3, hi AS "max", round((lo - m)/s, 4) AS z_min,
  round((q1 - m)/s, 4) AS z_q1, round((q2 - m)/s, 4) AS z_median, round((q3 - m)/s, 4) AS z_q3,
  round((hi - m)/s, 4) AS z_max FROM prof"""))
def feature_profile(spark, sf_dir):
    p = ft.feature_profile(train_rows(spark, sf_dir))
    z = [_r(c, 4).alias(c) for c in ("z_min", "z_q1", "z_median", "z_q3", "z_max")]
    return p.select("channel", "count", "min", "q1", "median", "q3", "max", *z)


@query("zscore_masked", o.with_(*_CTES, *_TRAIN0, _ROWS, "stats AS (" + _stats_sql(CHANNELS).replace(", 6)", ", 12)") + ")", select=f"""
SELECT {o.KEY}, bucket::INTEGER AS bucket, {', '.join(
    f"round(CASE WHEN {c} <> 0 THEN ({c} - (SELECT mean FROM stats WHERE name = '{c}')) / "
    f"(SELECT std FROM stats WHERE name = '{c}') ELSE 0 END, 5) AS {c}" for c in CHANNELS)} FROM rows_"""))
def zscore_masked(spark, sf_dir):
    rows = train_rows(spark, sf_dir)
    s = ft.stats_array(ft.norm_stats(rows))
    return rows.withColumn("s", s).select(
        *SERIES, "bucket", *[
            _r(vectors.zscore(F.col(c), F.col("s")[i]["mean"], F.col("s")[i]["std"]), 5).alias(c)
            for i, c in enumerate(CHANNELS)])


@query("unpadded_rows", o.with_(*_CTES, *_TRAIN0, _ROWS, select=f"""
SELECT {o.KEY}, bucket::INTEGER AS bucket, {', '.join(CHANNELS)} FROM rows_
WHERE {' AND '.join(f'{c} <> 0' for c in CHANNELS)}"""))
def unpadded_rows(spark, sf_dir):
    return quality.unpadded_rows(train_rows(spark, sf_dir), normalised=False).select(
        *SERIES, "bucket", *CHANNELS)


@query("unpadded_rows_normalised",
       f"SELECT DISTINCT {', '.join(CHANNELS)} FROM ({ORACLES['zscore_masked']})")
def unpadded_rows_normalised(spark, sf_dir):
    return quality.unpadded_rows(zscore_masked(spark, sf_dir), normalised=True)


# --- examples ----------------------------------------------------------------

#: Position of every filled bucket in a flat vector, by which vectors are compared.
_FLAT_SUM = " + ".join(f"(16*bucket + {i + 1})*{c}" for i, c in enumerate(CHANNELS))


def _example_sql(labels_from: str = "labels", extra: str = "") -> str:
    return f"""
SELECT l.bbox, l."year", l.lon, l.lat, l.CDL, l.start_day, l.label, 400::BIGINT AS width, {extra}
  coalesce(x.total, 0)::BIGINT AS weighted_sum
FROM {labels_from} l LEFT JOIN (SELECT {o.KEY}, start_day, sum({_FLAT_SUM}) AS total FROM rows_ GROUP BY ALL) x
USING ({o.KEY}, start_day)"""


def _example_view(ex):
    weights = F.transform("features", lambda x, i: x.cast("double") * (i + 1))
    return ex.select(
        *SERIES, "start_day", vectors.argmax(F.col("one_hot")).alias("label"),
        F.size("features").cast("bigint").alias("width"),
        F.aggregate(weights, F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("weighted_sum"))


_DET = "('0x' || substr(md5(day_sum::VARCHAR), 1, 8))::BIGINT % 1000 % greatest(1, last_day - 120)"
_IMGS = f"""imgs AS (SELECT *, (sum("day") OVER (PARTITION BY {o.KEY}))::BIGINT AS day_sum FROM img)"""


@query("make_examples", o.with_(
    *_CTES, _IMGS, *o.windows(_DET, cap="25", source="imgs", where=o.NO_DOUBLE), _ROWS,
    select=_example_sql()))
def make_examples(spark, sf_dir):
    return _example_view(ft.make_examples(train_series(spark, sf_dir), SPEC, keep=SERIES))


@query("make_examples_random", o.with_(
    *_CTES, *o.windows(_STARTS["random"], cap="25", where=o.NO_DOUBLE, pick=o.IMAGE_RANK), _ROWS,
    select=_example_sql()))
def make_examples_random(spark, sf_dir):
    cut = wn.cut_random(tables.drop_double_crops(masked(spark, sf_dir)), SPEC)
    return _example_view(ft.make_examples(cut, SPEC, keep=SERIES))


@query("make_test_examples", o.with_(
    *_CTES, "swept AS (SELECT *, unnest([" + ", ".join(map(str, SWEEP_START_DAYS)) + "]) AS begin_day FROM img)",
    *o.windows("begin_day", source="swept"), _ROWS, select=_example_sql()))
def make_test_examples(spark, sf_dir):
    s = wn.sweep_start_days(series(spark, sf_dir))
    return _example_view(ft.make_examples(s, SPEC, start_day=F.col("start_day"), keep=SERIES))


@query("normalised_examples", o.with_(
    *_CTES, *_TRAIN0, _ROWS, "stats AS (" + _stats_sql(CHANNELS).replace(", 6)", ", 12)") + ")", f"""
z AS (SELECT {o.KEY}, start_day, count(*) AS filled, {' + '.join(
    f"sum(CASE WHEN {c} <> 0 THEN abs(({c} - (SELECT mean FROM stats WHERE name = '{c}'))/"
    f"(SELECT std FROM stats WHERE name = '{c}')) ELSE 0 END)" for c in CHANNELS)} AS total
  FROM rows_ GROUP BY ALL)""", select=f"""
SELECT l.bbox, l."year", l.lon, l.lat, l.CDL, l.label, round(coalesce(z.total, 0), 1) AS absolute_sum
FROM labels l LEFT JOIN z USING ({o.KEY}, start_day)"""))
def normalised_examples(spark, sf_dir):
    s = train_series(spark, sf_dir)
    stats = ft.norm_stats(train_rows(spark, sf_dir))
    ex = ft.make_examples(s, SPEC, stats, start_day=F.lit(0), keep=SERIES)
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + F.abs(x.cast("double")))
    return ex.select(*SERIES, "label", _r(total, 1).alias("absolute_sum"))


# --- label counts and configuration reports ----------------------------------

@query("label_counts", o.with_(*_CTES, *_TRAIN0, select="""
SELECT label, count(*) AS "count" FROM labels GROUP BY label"""))
def label_counts(spark, sf_dir):
    s = wn.cut(wn.slim(train_series(spark, sf_dir)).withColumn("start_day", F.lit(0)), SPEC)
    return labels.label_windows(s, FRAMES_TO_CHECK).groupBy("label").count()


_LEGEND_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(LEGEND))


@query("class_balance", o.with_(*_CTES, *_TRAIN0, f"""
legend7 AS (SELECT * FROM (VALUES {_LEGEND_ROWS}) t(label, name))""", """
n AS (SELECT l.label, l.name, count(x.label) AS "count" FROM legend7 l LEFT JOIN labels x USING (label) GROUP BY ALL)""",
    select=f"""
SELECT label, name, "count", round("count"/sum("count") OVER (), 6) AS share,
  "count"/sum("count") OVER () < {IMBALANCE_SHARE} AS scarce,
  bool_or("count"/(SELECT sum("count") FROM n) < {IMBALANCE_SHARE}) OVER () AS imbalanced FROM n"""))
def class_balance(spark, sf_dir):
    return sweeps.class_balance(label_counts(spark, sf_dir), IMBALANCE_SHARE).withColumn(
        "share", _r("share"))


@query("sweep_label_counts", o.with_(
    *_CTES, f"swept AS (SELECT *, unnest([{', '.join(map(str, SWEEP_START_DAYS))}]) AS begin_day FROM img)",
    *o.windows("begin_day", source="swept"), select="""
SELECT start_day, label, count(*) AS windows, sum(buckets)::BIGINT AS buckets FROM labels GROUP BY ALL"""))
def sweep_label_counts(spark, sf_dir):
    return swept_labels(spark, sf_dir).groupBy("start_day", "label").agg(
        F.count(F.lit(1)).alias("windows"),
        F.sum(F.size("picks")).cast("bigint").alias("buckets"))


_SUMMARY = """
summary AS (SELECT config, count(*) AS total_samples, count(*) FILTER (label = 1) AS cultivated_count, {}
  FROM labels GROUP BY config)""".format(", ".join(
    f"count(*) FILTER (label = {i}) AS label_{i}" for i in range(len(LEGEND))))


@query("sweep_summary", o.with_(*CONFIG_CTES, _SUMMARY, select=f"""
SELECT *, round(cultivated_count/total_samples, 6) AS cultivated_ratio FROM summary"""))
def sweep_summary(spark, sf_dir):
    return sweeps.summarise(config_labels(spark, sf_dir)).withColumn(
        "cultivated_ratio", _r("cultivated_ratio"))


@query("top_configs", o.with_(*CONFIG_CTES, _SUMMARY, select="""
SELECT row_number() OVER (ORDER BY cultivated_count/total_samples DESC, config) AS rank, config, total_samples,
  cultivated_count, round(cultivated_count/total_samples, 6) AS cultivated_ratio FROM summary
ORDER BY rank LIMIT 5"""))
def top_configs(spark, sf_dir):
    best = sweeps.top_configs(sweeps.summarise(config_labels(spark, sf_dir)))
    return best.select("rank", "config", "total_samples", "cultivated_count",
                       _r("cultivated_ratio").alias("cultivated_ratio"))


# --- sampling and augmentation -----------------------------------------------

_HASH = """('0x' || substr(md5(concat_ws('|', '42', bbox, "year"::VARCHAR, round(lon*1000000)::BIGINT::VARCHAR,
  round(lat*1000000)::BIGINT::VARCHAR, CDL)), 1, 8))::BIGINT"""


@query("bernoulli_pick", o.with_(*_CTES, select=f"""
SELECT {o.KEY}, num_images FROM (SELECT DISTINCT {o.KEY}, num_images FROM img WHERE CDL = 'Corn')
WHERE {_HASH} % 100 < 1"""))
def bernoulli_pick(spark, sf_dir):
    s = series(spark, sf_dir).where(F.col("CDL") == "Corn")
    return sampling.bernoulli(s, sampling.series_hash(), percent=1).select(*SERIES, "num_images")


@query("first_of_sample", o.with_(*_CTES, select=f"""
SELECT {o.KEY}, num_images FROM (SELECT DISTINCT {o.KEY}, num_images FROM img)
WHERE {_HASH} % 100 < 1 ORDER BY bbox, "year", lon, lat, CDL LIMIT 1"""))
def first_of_sample(spark, sf_dir):
    picked = sampling.bernoulli(series(spark, sf_dir), sampling.series_hash(), percent=1)
    return sampling.first_row(picked.select(*SERIES, "num_images"), SERIES)


@query("shuffle_batches", o.with_(*_CTES, *_TRAIN0, select=f"""
SELECT {o.KEY}, label, ((row_number() OVER (ORDER BY {_HASH}, lon, lat, "year") - 1) // 64)::BIGINT AS batch_id
FROM labels"""))
def shuffle_batches(spark, sf_dir):
    s = wn.cut(wn.slim(train_series(spark, sf_dir)).withColumn("start_day", F.lit(0)), SPEC)
    rows = labels.label_windows(s, FRAMES_TO_CHECK).select(*SERIES, "label")
    return sampling.shuffle_batches(rows, sampling.series_hash(), ["lon", "lat", "year"], 64)
