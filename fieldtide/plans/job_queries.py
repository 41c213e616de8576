"""Queries over sinks, augmentation, models and streams.

Those that store something write below the shared folder of the session and
return what a reader of the stored table sees.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fieldtide import schemas
from fieldtide.constants import (
    BANDS, CHANNELS, DAYS_IN_SERIES, FRAMES_TO_CHECK, LEGEND, SERIES, SWEEP_START_DAYS,
)
from fieldtide.functions import vectors
from fieldtide.operators import (
    assess, augment, features as ft, labels, model, sampling, series as sr, sweeps,
    windows as wn,
)
from fieldtide.plans import oracle as o
from fieldtide.plans.feature_queries import (
    _HASH, _ROWS, _SUMMARY, _TRAIN0, _stats_sql,
)
from fieldtide.plans.registry import query
from fieldtide.plans.series_queries import (
    CONFIG_CTES, SPEC, config_labels, full_series, masked, series, train_series,
)
from fieldtide.session import shared_folder
from fieldtide.sources import derived, sinks, tables
from fieldtide.streaming import commits, ingest

WIDTH = len(CHANNELS)


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- sinks and sources ------------------------------------------------------------

@query("sink_samples", o.with_(o.OBS, select="""
SELECT bbox, "year", CDL, lon, lat, count(*) AS samples FROM obs GROUP BY ALL"""))
def sink_samples(spark, sf_dir):
    root = shared_folder(spark, "samples")
    sinks.append_samples(derived.observations(spark, sf_dir), root)
    stored = tables.scan_any(spark, root, schemas.SAMPLES)
    return stored.groupBy("bbox", "year", "CDL", "lon", "lat").agg(
        F.count(F.lit(1)).alias("samples"))


@query("sink_observations", o.with_(o.OBS, o.MASKED, select=f"""
SELECT bbox, "year", tile, count(*) AS images, {', '.join(f'sum({b})::BIGINT AS {b}' for b in BANDS)} FROM masked GROUP BY ALL"""))
def sink_observations(spark, sf_dir):
    root = shared_folder(spark, "observations")
    sinks.append_observations(masked(spark, sf_dir), root, ["bbox", "year"])
    return tables.read_observations(spark, root).groupBy("bbox", "year", "tile").agg(
        F.count(F.lit(1)).alias("images"), *[F.sum(b).alias(b) for b in BANDS])


@query("scan_any", o.with_(o.OBS, select='SELECT CDL, count(*) AS "count" FROM obs GROUP BY CDL'))
def scan_any(spark, sf_dir):
    files = tables.scan_any(spark, f"{sf_dir}/lineitem*")
    return derived.observations_of(files).groupBy("CDL").count()


@query("sink_series", o.with_(*o.SERIES_CTES, select="""
SELECT bbox, "year", count(DISTINCT (lon, lat, CDL)) AS series, count(*) AS images, sum(scl)::BIGINT AS scl_sum FROM img GROUP BY ALL"""))
def sink_series(spark, sf_dir):
    root = shared_folder(spark, "series")
    packed = sr.pack_series(full_series(spark, sf_dir))
    sinks.write_series(packed, root)
    sinks.write_series(packed, root)  # running again replaces, never doubles
    back = sr.unpack_series(tables.scan_any(spark, root, schemas.PACKED_SERIES))
    scl = F.aggregate("images", F.lit(0).cast("bigint"), lambda a, i: a + i["scl"])
    return back.groupBy("bbox", "year").agg(
        F.count(F.lit(1)).alias("series"), F.sum("num_images").alias("images"),
        F.sum(scl).alias("scl_sum"))


@query("sink_training_set", o.with_(*o.SERIES_CTES, *_TRAIN0, select="""
SELECT CASE WHEN "year" < 1999 THEN 'train' ELSE 'val' END AS split, label, count(*) AS examples, 400::BIGINT AS width
FROM labels GROUP BY ALL"""))
def sink_training_set(spark, sf_dir):
    root = shared_folder(spark, "training")
    sinks.write_training_set(_examples(spark, sf_dir), root)
    return spark.read.parquet(root).groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("examples"),
        F.max(F.size("features")).cast("bigint").alias("width"))


def _examples(spark, sf_dir):
    """Training examples of the first window with their split."""
    ex = ft.make_examples(
        train_series(spark, sf_dir), SPEC, start_day=F.lit(0), keep=SERIES)
    return ex.select(
        *SERIES, "features", "label", "one_hot",
        F.when(F.col("year") < 1999, "train").otherwise("val").alias("split"))


@query("sink_results", o.with_(o.SCORES, o.RESULTS, select="""
SELECT 'predictions' AS part, prediction, count(*) AS "rows" FROM results GROUP BY ALL
UNION ALL SELECT 'high_confidence', prediction, count(*) FROM results WHERE confidence_score >= 0.3 GROUP BY ALL"""))
def sink_results(spark, sf_dir):
    root = shared_folder(spark, "results")
    rows = assess.predict(derived.scores(spark, sf_dir), 2021, DAYS_IN_SERIES)
    sinks.write_results(rows.drop("probs"), root, 0.3)
    read = lambda part: spark.read.parquet(f"{root}/{part}").groupBy(
        F.lit(part).alias("part"), "prediction").agg(F.count(F.lit(1)).alias("rows"))
    return read("predictions").unionByName(read("high_confidence"))


@query("sink_sweep_csv", o.with_(*CONFIG_CTES, _SUMMARY, select="""
SELECT config, total_samples, cultivated_count, round(cultivated_count/total_samples, 6) AS cultivated_ratio FROM summary"""))
def sink_sweep_csv(spark, sf_dir):
    root = shared_folder(spark, "sweep")
    sinks.write_sweep_csv(sweeps.summarise(config_labels(spark, sf_dir)).select(
        "config", "total_samples", "cultivated_count",
        _r("cultivated_ratio").alias("cultivated_ratio")), root)
    return spark.read.option("header", True).schema(
        "config string, total_samples bigint, cultivated_count bigint, cultivated_ratio double"
    ).csv(root)


# --- augmentation -------------------------------------------------------------------

BATCH = 64
_BATCHED = f"""batched AS (SELECT *, ((row_number() OVER (ORDER BY {_HASH}, lon, lat, "year") - 1) // {BATCH})::BIGINT AS batch_id,
  {_HASH} AS h FROM labels)"""
_BATCH_HASH = "('0x' || substr(md5('42|batch|' || batch_id::VARCHAR), 1, 8))::BIGINT"
_H2 = _HASH.replace("'42'", "'7'")


def _u(h: str, i: str, first: int = 1) -> str:
    digits = f"substr(md5(({h})::VARCHAR || '|' || ({i})::VARCHAR), {first}, 13)"
    return f"((('0x' || {digits})::BIGINT::DOUBLE + 0.5e0)/4503599627370496e0)"


def _batches(spark, sf_dir):
    rows = _examples(spark, sf_dir)
    return sampling.shuffle_batches(rows, sampling.series_hash(), ["lon", "lat", "year"], BATCH)


_CELLS_SQL = f"""cells_ AS (SELECT {o.KEY}, bucket*16 + pos AS i, v::DOUBLE AS v FROM (SELECT {o.KEY}, bucket,
  unnest([{', '.join(f'{c}::BIGINT' for c in CHANNELS)}]) AS v, unnest(range(16)) AS pos FROM rows_))"""


def _long(df, *keep):
    """One row per feature, so that the check compares the features themselves."""
    return df.select(*SERIES, *keep, F.posexplode(vectors.held("features")).alias("i", "v")).withColumn(
        "v", _r(F.col("v").cast("double"), 5))


@query("jitter_scale", o.with_(*o.SERIES_CTES, *_TRAIN0, _ROWS, _BATCHED, _CELLS_SQL, f"""
grid AS (SELECT {o.KEY}, h, batch_id, unnest(range(400)) AS i FROM batched)""", select=f"""
SELECT {o.KEY}, batch_id, i::INTEGER AS i, round((((coalesce(c.v, 0) +
  sqrt(ln({_u('h', 'i')})*-2)*cos({_u('h', 'i', 14)}*{2 * 3.141592653589793!r}::DOUBLE)*0.01e0)
  *({_u(_BATCH_HASH, '0')}*(1.1e0 - 0.9e0) + 0.9e0))::FLOAT)::DOUBLE, 5) AS v
FROM grid LEFT JOIN cells_ c USING ({o.KEY}, i)"""))
def jitter_scale(spark, sf_dir):
    return _long(augment.jitter_scale(_batches(spark, sf_dir), sampling.series_hash()), "batch_id")


@query("mixup", o.with_(*o.SERIES_CTES, *_TRAIN0, _ROWS, _BATCHED, _CELLS_SQL, f"""
hashed AS (SELECT *, {_H2} AS h2 FROM batched)""", """
pos AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY h, h2) AS position,
  row_number() OVER (PARTITION BY batch_id ORDER BY h2, h) AS slot FROM hashed)""", f"""
tot AS (SELECT p.*, i, coalesce(c.v, 0) AS v FROM (SELECT *, unnest(range(400)) AS i FROM pos) p
  LEFT JOIN cells_ c USING ({o.KEY}, i))""", select=f"""
SELECT a.bbox, a."year", a.lon, a.lat, a.CDL, a.batch_id, a.i::INTEGER AS i,
  round(((0.75e0*a.v + (1 - 0.75e0)*b.v)::FLOAT)::DOUBLE, 5) AS v,
  round(0.75e0*(a.label = 3)::INTEGER + 0.25e0*(b.label = 3)::INTEGER, 6) AS y3
FROM tot a JOIN tot b ON a.batch_id = b.batch_id AND a.position = b.slot AND a.i = b.i"""))
def mixup(spark, sf_dir):
    out = augment.mixup(_batches(spark, sf_dir), sampling.series_hash(),
                        sampling.series_hash(7), lam=0.75)
    return _long(out.withColumn("y3", _r(F.col("one_hot")[3].cast("double"))), "batch_id", "y3")


_ALPHA = 0.4
_BETA = math.gamma(_ALPHA) ** 2 / math.gamma(2 * _ALPHA)
_BETA_SUM = " + ".join(
    f"{c!r}::DOUBLE*pow(mid, {n})" for n, c in enumerate(augment.beta_terms(_ALPHA)))


@query("mixup_weights", o.with_(*o.SERIES_CTES, *_TRAIN0, _BATCHED, f"""
b AS (SELECT batch_id, count(*) AS n, {_u(_BATCH_HASH, '0')} AS u FROM batched GROUP BY batch_id)""", f"""
halved AS (SELECT batch_id, n, u, 0e0 AS lo, 0.5e0 AS hi, 0 AS k FROM b UNION ALL
  SELECT batch_id, n, u, CASE WHEN f < least(u, 1 - u) THEN mid ELSE lo END,
    CASE WHEN f < least(u, 1 - u) THEN hi ELSE mid END, k + 1
  FROM (SELECT *, pow(mid, {_ALPHA}::DOUBLE)*({_BETA_SUM})/{_BETA!r}::DOUBLE AS f
    FROM (SELECT *, (lo + hi)/2 AS mid FROM halved WHERE k < 60)))""", select="""
SELECT batch_id, n, round(CASE WHEN u <= 0.5 THEN lo ELSE 1 - lo END, 6) AS weight FROM halved WHERE k = 60
""").replace("WITH ", "WITH RECURSIVE ", 1))
def mixup_weights(spark, sf_dir):
    out = augment.mixup(_batches(spark, sf_dir), sampling.series_hash(), sampling.series_hash(7))
    return out.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), _r(F.max("weight")).alias("weight"))


def _weighted(width: int):
    """Position-weighted sum of a flat vector, which tells orders apart."""
    terms = F.transform("features", lambda x, i: x.cast("double") * (i + 1))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), width


@query("time_channel", o.with_(*o.SERIES_CTES, *_TRAIN0, _ROWS, f"""
sums AS (SELECT {o.KEY}, sum({' + '.join(f'(17*bucket + {i + 1})*{c}' for i, c in enumerate(CHANNELS))}) AS total
  FROM rows_ GROUP BY ALL)""", select=f"""
SELECT {o.KEY}, 425::BIGINT AS width, round(coalesce(total, 0) + (SELECT sum((17*i + 17)*(i/24e0)) FROM range(25) t(i)), 0) AS total
FROM labels LEFT JOIN sums USING ({o.KEY})"""))
def time_channel(spark, sf_dir):
    out = augment.time_channel(_examples(spark, sf_dir), SPEC.size, WIDTH)
    return out.select(*SERIES, F.size("features").cast("bigint").alias("width"),
                      _r(_weighted(17)[0], 0).alias("total"))


@query("time_roll", o.with_(*o.SERIES_CTES, *_TRAIN0, _ROWS, _BATCHED, f"""
shifts AS (SELECT *, (floor({_u(_BATCH_HASH, '1')}*4) - 2)::INTEGER AS shift FROM batched)""", f"""
sums AS (SELECT r.bbox, r."year", r.lon, r.lat, r.CDL, sum({' + '.join(
    f'(16*((bucket + shift + 25) % 25) + {i + 1})*{c}' for i, c in enumerate(CHANNELS))}) AS total
  FROM rows_ r JOIN shifts s USING ({o.KEY}) GROUP BY ALL)""", select=f"""
SELECT {o.KEY}, batch_id, shift, coalesce(total, 0)::BIGINT AS total FROM shifts LEFT JOIN sums USING ({o.KEY})"""))
def time_roll(spark, sf_dir):
    rows = _batches(spark, sf_dir).withColumn("shift", augment.batch_shift())
    out = augment.time_roll(rows, F.col("shift"), SPEC.size, WIDTH)
    return out.select(*SERIES, "batch_id", "shift", _weighted(16)[0].cast("bigint").alias("total"))


# --- models --------------------------------------------------------------------------

def _centroids(train):
    window = wn.cut(train.withColumn("start_day", F.lit(0)), SPEC)
    labelled = labels.label_windows(window, FRAMES_TO_CHECK)
    return model.class_centroids(ft.pick_rows(labelled, "label"))


_PREFIXED = ", ".join(f"avg({c}::DOUBLE) FILTER ({c} <> 0) AS m_{c}" for c in CHANNELS)


#: Picked rows of all windows of the sweep, beside those of the training windows.
_SWEPT_ROWS = [
    "swept AS (SELECT *, unnest([" + ", ".join(map(str, SWEEP_START_DAYS)) + "]) AS begin_day FROM img)",
    *[c.replace("starts AS", "starts2 AS").replace("inside AS", "inside2 AS").replace("FROM inside ", "FROM inside2 ")
       .replace("kept AS", "kept2 AS").replace("FROM kept)", "FROM kept2)").replace("placed AS", "placed2 AS")
       .replace("picks AS", "picks2 AS").replace("FROM placed\n", "FROM placed2\n")
      for c in o.windows("begin_day", source="swept")[:5]],
    f"rows2 AS (SELECT *, {o.INDEX_LIST} FROM picks2)",
]


@query("centroid_score", o.with_(
    *o.SERIES_CTES, *_TRAIN0, _ROWS,
    f"cent AS (SELECT label AS candidate, bucket, {_PREFIXED} FROM rows_ JOIN labels USING ({o.KEY}, start_day) GROUP BY ALL)",
    *_SWEPT_ROWS,
    f"""dist AS (SELECT {o.KEY}, start_day, candidate, sum({' + '.join(
        f'CASE WHEN {c} <> 0 AND m_{c} IS NOT NULL THEN pow({c} - m_{c}, 2) ELSE 0 END' for c in CHANNELS)})
        / nullif(sum({' + '.join(f'CASE WHEN {c} <> 0 AND m_{c} IS NOT NULL THEN 1 ELSE 0 END' for c in CHANNELS)}), 0) AS distance
        FROM rows2 JOIN cent USING (bucket) GROUP BY ALL)""", select=f"""
SELECT {o.KEY}, start_day, candidate AS prediction, round(distance, 2) AS distance FROM dist WHERE distance IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {o.KEY}, start_day ORDER BY distance, candidate) = 1"""))
def centroid_score(spark, sf_dir):
    whole = _stored_series(spark, sf_dir)
    ex = ft.swept_examples(whole, SPEC, SWEEP_START_DAYS, SERIES)
    scored = model.centroid_score(
        ex, _centroids(tables.drop_double_crops(whole)), SPEC.size, [*SERIES, "start_day"])
    return scored.withColumn("distance", _r("distance", 2))


#: Years from here on are held out of the fit.
FIRST_HELD_OUT = 1999


def _stored_series(spark, sf_dir):
    """Window series, written once; the crop filter looks at series keys only, so it comes later."""
    root = shared_folder(spark, "window-series")
    series(spark, sf_dir).write.parquet(root)
    return spark.read.parquet(root)


def _model_inputs(spark, sf_dir):
    """(all series, statistics, training examples with their split), each read from its table."""
    whole = _stored_series(spark, sf_dir)
    train = tables.drop_double_crops(whole)
    window = wn.cut(train.withColumn("start_day", F.lit(0)), SPEC)
    root = shared_folder(spark, "statistics")
    ft.norm_stats(ft.pick_rows(window, *SERIES)).write.parquet(root)
    stats = spark.read.parquet(root)
    ex = ft.swept_examples(train, SPEC, [0], SERIES, stats)
    split = F.when(F.col("year") < FIRST_HELD_OUT, "train").otherwise("val")
    root = shared_folder(spark, "training")
    sinks.write_training_set(ex.withColumn("split", split), root)
    return whole, stats, spark.read.parquet(root)


@query("train_classifier")
def train_classifier(spark, sf_dir):
    """Fitted on the early years, judged on the later ones it has not seen."""
    _, _, stored = _model_inputs(spark, sf_dir)
    fitted = model.train_classifier(stored.where("split = 'train'"), "logistic", SPEC.size * WIDTH)
    scored = model.score(fitted, stored.where("split = 'val'")).withColumn(
        "prediction", vectors.argmax(F.col("probs")))
    return scored.groupBy("label", "prediction").count()


def _swept_examples(whole, stats):
    return ft.swept_examples(whole, SPEC, SWEEP_START_DAYS, SERIES, stats)


@query("score_sweep")
def score_sweep(spark, sf_dir):
    """All series at all start days under a fitted forest, as a result table."""
    whole, stats, stored = _model_inputs(spark, sf_dir)
    fitted = model.train_classifier(stored.where("split = 'train'"), "forest", SPEC.size * WIDTH)
    scored = model.score(fitted, _swept_examples(whole, stats)).withColumnRenamed("label", "true_label")
    named = assess.label_names(assess.predict(scored, F.col("year"), SPEC.days))
    return named.select(
        *SERIES, "start_day", "true_label", "prediction", "predicted_label",
        _r("confidence_score").alias("confidence_score"))


_LOGITS = " + ".join(
    f"sum(CASE WHEN {c} <> 0 THEN ({c} - (SELECT mean FROM stats WHERE name = '{c}'))/"
    f"(SELECT std FROM stats WHERE name = '{c}') ELSE 0 END * cos((bucket*{WIDTH} + {k + 1})*j::DOUBLE))"
    for k, c in enumerate(CHANNELS))


@query("score_external", o.with_(
    *o.SERIES_CTES, *_TRAIN0, _ROWS, "stats AS (" + _stats_sql(CHANNELS).replace(", 6)", ", 12)") + ")", *_SWEPT_ROWS,
    f"logits AS (SELECT {o.KEY}, start_day, j, {_LOGITS} AS z FROM rows2, range(1, {len(LEGEND) + 1}) t(j) GROUP BY ALL)",
    f"""best AS (SELECT {o.KEY}, start_day, (j - 1)::INTEGER AS prediction FROM logits
  QUALIFY row_number() OVER (PARTITION BY {o.KEY}, start_day ORDER BY z DESC, j) = 1)""", select=f"""
SELECT s.start_day, coalesce(prediction, 0) AS prediction, count(*) AS "count"
FROM starts2 s LEFT JOIN best USING ({o.KEY}, start_day) GROUP BY ALL"""))
def score_external(spark, sf_dir):
    """The sweep under a model from outside Spark, here a fixed projection of the features."""
    whole, stats, _ = _model_inputs(spark, sf_dir)
    ex = _swept_examples(whole, stats)
    width, classes = SPEC.size * WIDTH, len(LEGEND)

    def predict(matrix):
        import numpy as np

        weights = np.cos(np.outer(np.arange(1, width + 1), np.arange(1, classes + 1)))
        logits = np.asarray(matrix, dtype="float64") @ weights / width
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    scored = model.score_external(ex, predict, [*SERIES, "start_day", "label"])
    return scored.groupBy("start_day", vectors.argmax(F.col("probs")).alias("prediction")).count()


@query("resume_sweep", o.with_(
    *o.SERIES_CTES, "swept AS (SELECT *, unnest([" + ", ".join(map(str, SWEEP_START_DAYS)) + "]) AS begin_day FROM img)",
    *o.windows("begin_day", source="swept"), select="""
SELECT start_day, label, count(*) AS windows FROM labels GROUP BY ALL"""))
def resume_sweep(spark, sf_dir):
    """A run that stopped early and the run that goes on read one stored series."""
    root = shared_folder(spark, "resume")
    folder = shared_folder(spark, "sweep-series")
    wn.slim(series(spark, sf_dir)).write.parquet(folder)
    run = lambda days: _sweep_days(spark.read.parquet(folder), days)
    model.resume_sweep(spark, root, SWEEP_START_DAYS[:6], run)  # a run that stopped early
    whole = model.resume_sweep(spark, root, SWEEP_START_DAYS, run)
    return whole.groupBy("start_day", "label").agg(F.count(F.lit(1)).alias("windows"))


def _sweep_days(slim, days):
    return labels.label_windows(wn.cut(wn.sweep_start_days(slim, days), SPEC), FRAMES_TO_CHECK).select(
        *SERIES, "start_day", "label")


# --- streams ---------------------------------------------------------------------------

_TILE = "(split_part(id, '_', 2) || '_' || split_part(id, '_', 4))"


@query("stream_scene_ingest", o.with_(o.SCENES, select=f"""
SELECT {_TILE} AS tile, datetime::DATE AS scene_date, count(*) AS entries FROM scenes
WHERE coalesce(json_extract_string(properties, '$."s2:vegetation_percentage"')::DOUBLE, 0) > 30 GROUP BY ALL"""))
def stream_scene_ingest(spark, sf_dir):
    from fieldtide.functions import text
    from fieldtide.operators import scenes as sc

    root, mark = shared_folder(spark, "scenes"), shared_folder(spark, "progress")
    for restart in (False, True):
        events = ingest.read_files(spark, sf_dir, schemas.SOURCES["events"], "events.parquet")
        fit = sc.scene_coverage(derived.scenes_of(events)).select(
            "id", "seq", text.scene_tile(F.col("id")).alias("tile"),
            text.scene_date(F.col("datetime")).alias("scene_date"))
        # a restart without its checkpoint replays everything; nothing may double
        ingest.ingest_scenes(
            fit, root, mark + ("-lost" if restart else ""), ["scene_date"], ["id", "seq"])
    return spark.read.parquet(root).groupBy("tile", "scene_date").agg(
        F.count(F.lit(1)).alias("entries"))


@query("stream_observations", o.with_(o.OBS, o.MASKED, select=f"""
SELECT bbox, "year", tile, count(*) AS images, {', '.join(f'sum({b})::BIGINT AS {b}' for b in BANDS)} FROM masked GROUP BY ALL"""))
def stream_observations(spark, sf_dir):
    """Mask, clean and append, run twice without its progress: nothing is lost or doubled."""
    root, mark = shared_folder(spark, "observations"), shared_folder(spark, "progress")
    for attempt in (0, 1):
        rows = ingest.read_files(spark, sf_dir, schemas.SOURCES["lineitem"], "lineitem.parquet")
        ingest.ingest_observations(
            derived.observations_of(rows), root, f"{mark}-{attempt}", ["bbox", "year"])
    return tables.read_observations(spark, root).groupBy("bbox", "year", "tile").agg(
        F.count(F.lit(1)).alias("images"), *[F.sum(b).cast("bigint").alias(b) for b in BANDS])


@query("stream_dedup_scene", o.with_(o.SCENES, select="SELECT DISTINCT id FROM scenes"))
def stream_dedup_scene(spark, sf_dir):
    root, mark = shared_folder(spark, "unique"), shared_folder(spark, "progress")
    events = ingest.read_files(spark, sf_dir, schemas.SOURCES["events"], "events.parquet")
    ingest.dedup_scenes(derived.scenes_of(events), root, mark, ["id"], "datetime", "40 days")
    return spark.read.parquet(root).select("id")


@query("stream_dedup_observations", o.with_(o.OBS, select="""
SELECT DISTINCT bbox, "year", tile, scene_date, lon, lat, 1::BIGINT AS images FROM obs"""))
def stream_dedup_observations(spark, sf_dir):
    """One observation per pixel, tile and date; the second run has lost its checkpoint."""
    root, mark = shared_folder(spark, "unique-obs"), shared_folder(spark, "progress")
    for attempt in (0, 1):
        rows = ingest.read_files(spark, sf_dir, schemas.SOURCES["lineitem"], "lineitem.parquet")
        ingest.dedup_observations(derived.observations_of(rows), root, f"{mark}-{attempt}", "4000 days")
        sinks.drop_table(spark, f"{mark}-{attempt}")  # lost behind the run
    return spark.read.parquet(root).groupBy(*ingest.OBSERVATION).agg(F.count(F.lit(1)).alias("images"))


@query("stream_series_refresh", o.with_(*o.SERIES_CTES, select=f"""
SELECT {o.KEY}, num_images, last_day FROM img GROUP BY ALL"""))
def stream_series_refresh(spark, sf_dir):
    root = shared_folder(spark, "refresh")
    rows = ingest.read_files(spark, sf_dir, schemas.SOURCES["lineitem"], "lineitem.parquet")
    ingest.refresh_series(derived.observations_of(rows), f"{root}/obs", f"{root}/series",
                          f"{root}/progress")
    commits.compact(spark, f"{root}/obs", ingest.AOI_YEAR)
    return spark.read.parquet(f"{root}/series").select(*SERIES, "num_images", "last_day")


@query("stream_class_counts", """
SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS "count" FROM events GROUP BY ALL""")
def stream_class_counts(spark, sf_dir):
    root, mark = shared_folder(spark, "counts"), shared_folder(spark, "progress")
    events = ingest.read_files(spark, sf_dir, schemas.SOURCES["events"], "events.parquet")
    ingest.class_counts(events, root, mark, "ts", "event_type")
    return spark.read.parquet(root).drop("day")
