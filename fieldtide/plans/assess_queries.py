"""Queries over scored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtide.constants import DAYS_IN_SERIES, LEGEND, PROB_EPSILON
from fieldtide.functions import vectors
from fieldtide.operators import assess, labels
from fieldtide.plans import oracle as o
from fieldtide.plans.registry import query
from fieldtide.sources import derived

YEAR = 2021
ALPHA = [0.25, 0.5, 0.75, 1.0, 1.0, 1.0, 1.25]
_BASE = [o.SCORES, o.RESULTS]
_NAME = f"{o.strings(LEGEND)}[{{}} + 1]"


def _r(c, digits: int = 6):
    return F.round(c, digits)


def results(spark, sf_dir):
    return assess.predict(derived.scores(spark, sf_dir), YEAR, DAYS_IN_SERIES)


_CLASS = """
pairs AS (SELECT true_label, prediction, count(*) AS n FROM results GROUP BY ALL),
cls AS (SELECT label, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted FROM (
  SELECT true_label AS label, CASE WHEN true_label = prediction THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM pairs
  UNION ALL SELECT prediction, 0, 0, n FROM pairs) GROUP BY label),
prf AS (SELECT *, CASE WHEN predicted > 0 THEN tp/predicted ELSE 0 END AS "precision",
  CASE WHEN support > 0 THEN tp/support ELSE 0 END AS recall,
  CASE WHEN support + predicted > 0 THEN 2*tp/(support + predicted) ELSE 0 END AS f1 FROM cls)"""


@query("argmax_confidence", o.with_(*_BASE, select="""
SELECT pixel_id, start_day, prediction, round(confidence_score, 6) AS confidence_score, count(*) AS n
FROM results GROUP BY ALL"""))
def argmax_confidence(spark, sf_dir):
    return results(spark, sf_dir).groupBy(
        "pixel_id", "start_day", "prediction",
        _r("confidence_score").alias("confidence_score")).agg(F.count(F.lit(1)).alias("n"))


@query("prob_columns", o.with_(*_BASE, select="SELECT pixel_id, start_day, h, " + ", ".join(
    f'round(probs[{i + 1}], 6) AS "prob_{n}"' for i, n in enumerate(LEGEND)) + " FROM results"))
def prob_columns(spark, sf_dir):
    wide = results(spark, sf_dir).select(
        "pixel_id", "start_day", "h", *vectors.probability_columns("probs", LEGEND))
    return wide.select("pixel_id", "start_day", "h", *[_r(f"`prob_{n}`").alias(f"prob_{n}") for n in LEGEND])


@query("label_names", o.with_(*_BASE, select=f"""
SELECT prediction, {_NAME.format('prediction')} AS predicted_label, count(*) AS n FROM results GROUP BY ALL"""))
def label_names(spark, sf_dir):
    return assess.label_names(results(spark, sf_dir)).groupBy("prediction", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"))


@query("complete_legend", o.with_(*_BASE, f"""
legend7 AS (SELECT unnest(range(7))::INTEGER AS label, unnest({o.strings(LEGEND)}) AS name)""", select="""
SELECT label, name, count(prediction) AS "count" FROM legend7 LEFT JOIN
  (SELECT * FROM results WHERE confidence_score >= 0.45) r ON label = prediction GROUP BY ALL"""))
def complete_legend(spark, sf_dir):
    sure = results(spark, sf_dir).where(F.col("confidence_score") >= 0.45)
    return labels.complete_legend(sure.groupBy(F.col("prediction").alias("label")).count())


@query("prediction_date", o.with_(*_BASE, select="""
SELECT DISTINCT start_day, prediction_date FROM results"""))
def prediction_date(spark, sf_dir):
    return results(spark, sf_dir).select("start_day", "prediction_date").distinct()


@query("snapshot_day", o.with_(*_BASE, select="""
SELECT pixel_id, longitude, latitude, start_day, prediction_date, true_label, prediction, count(*) AS n
FROM results WHERE start_day IN (15, 105, 195) GROUP BY ALL"""))
def snapshot_day(spark, sf_dir):
    return assess.snapshot(results(spark, sf_dir), [15, 105, 195]).groupBy(
        "pixel_id", "longitude", "latitude", "start_day", "prediction_date", "true_label",
        "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("high_confidence", o.with_(*_BASE, select="""
SELECT count(*) FILTER (confidence_score >= 0.3) AS sure, count(*) AS total,
  round(count(*) FILTER (confidence_score >= 0.3)*100e0/count(*), 6) AS percent FROM results"""))
def high_confidence(spark, sf_dir):
    return assess.high_confidence(results(spark, sf_dir), 0.3).withColumn("percent", _r("percent"))


@query("confusion_matrix", o.with_(*_BASE, select=f"""
SELECT i::INTEGER AS true_label, {', '.join(
    f'count(*) FILTER (prediction = {i}) AS pred_{i}' for i in range(7))}
FROM range(7) t(i) LEFT JOIN results ON true_label = i GROUP BY i"""))
def confusion_matrix(spark, sf_dir):
    return assess.confusion_matrix(results(spark, sf_dir))


@query("overall_metrics", o.with_(*_BASE, _CLASS, select="""
SELECT round(sum(tp)/sum(support), 6) AS accuracy, round(sum(tp)/sum(support), 6) AS micro_f1,
  round(avg(f1), 6) AS macro_f1, round(sum(f1*support)/sum(support), 6) AS weighted_f1 FROM prf"""))
def overall_metrics(spark, sf_dir):
    m = assess.overall_metrics(results(spark, sf_dir))
    return m.select(*[_r(c).alias(c) for c in m.columns])


_REPORT = f"""
SELECT {_NAME.format('label')} AS name, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(f1, 6) AS f1, support FROM prf
UNION ALL SELECT 'macro avg', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM prf
UNION ALL SELECT 'weighted avg', round(sum("precision"*support)/sum(support), 6), round(sum(recall*support)/sum(support), 6),
  round(sum(f1*support)/sum(support), 6), sum(support)::BIGINT FROM prf"""


@query("classification_report", o.with_(*_BASE, _CLASS, select=_REPORT))
def classification_report(spark, sf_dir):
    rep = assess.classification_report(results(spark, sf_dir))
    return rep.select("name", *[_r(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("balanced_accuracy", o.with_(*_BASE, _CLASS, select=f"""
SELECT {_NAME.format('label')} AS name, round(recall, 6) AS recall,
  round(avg(recall) OVER (), 6) AS balanced_accuracy FROM prf WHERE support > 0"""))
def balanced_accuracy(spark, sf_dir):
    b = assess.balanced_accuracy(results(spark, sf_dir))
    return b.select("name", _r("recall").alias("recall"),
                    _r("balanced_accuracy").alias("balanced_accuracy"))


@query("weighted_prf", o.with_(*_BASE, _CLASS, select="""
SELECT round(sum("precision"*support)/sum(support), 6) AS "precision",
  round(sum(recall*support)/sum(support), 6) AS recall, round(sum(f1*support)/sum(support), 6) AS f1 FROM prf"""))
def weighted_prf(spark, sf_dir):
    m = assess.weighted_prf(results(spark, sf_dir))
    return m.select(*[_r(c).alias(c) for c in m.columns])


_BY_DATE = """
by_date AS (SELECT prediction_date, start_day, count(*) AS "rows",
  avg((true_label = prediction)::INTEGER) AS accuracy FROM results GROUP BY ALL)"""


@query("accuracy_by_date", o.with_(*_BASE, _BY_DATE, select="""
SELECT prediction_date, start_day, "rows", round(accuracy, 6) AS accuracy FROM by_date ORDER BY prediction_date"""))
def accuracy_by_date(spark, sf_dir):
    return assess.accuracy_by_date(results(spark, sf_dir)).withColumn(
        "accuracy", _r("accuracy")).orderBy("prediction_date")


@query("accuracy_early_late", o.with_(*_BASE, _BY_DATE, select="""
SELECT d::INTEGER AS start_day, round(coalesce(accuracy, 0), 6) AS accuracy
FROM (SELECT unnest([15, 30, 120, 195]) AS d) LEFT JOIN by_date ON start_day = d"""))
def accuracy_early_late(spark, sf_dir):
    return assess.accuracy_on(results(spark, sf_dir), [15, 30, 120, 195]).withColumn(
        "accuracy", _r("accuracy"))


@query("best_worst_day", o.with_(*_BASE, _BY_DATE, select="""
SELECT (SELECT start_day FROM by_date ORDER BY accuracy, prediction_date LIMIT 1) AS worst_start_day,
  (SELECT start_day FROM by_date ORDER BY accuracy DESC, prediction_date LIMIT 1) AS best_start_day,
  round((SELECT min(accuracy) FROM by_date), 6) AS worst_accuracy,
  round((SELECT max(accuracy) FROM by_date), 6) AS best_accuracy"""))
def best_worst_day(spark, sf_dir):
    b = assess.best_worst_day(results(spark, sf_dir))
    return b.withColumn("worst_accuracy", _r("worst_accuracy")).withColumn(
        "best_accuracy", _r("best_accuracy"))


@query("representative_days", o.with_(*_BASE, """
days AS (SELECT start_day, row_number() OVER (ORDER BY start_day) - 1 AS i, count(*) OVER () AS n
  FROM (SELECT DISTINCT start_day FROM results))""", select="""
SELECT start_day FROM days WHERE n < 3 OR i IN (0, n // 2, n - 1)"""))
def representative_days(spark, sf_dir):
    return assess.representative_days(results(spark, sf_dir))


@query("confidence_summary", o.with_(*_BASE, select="""
SELECT count(*) AS "count", round(avg(confidence_score), 6) AS mean, round(min(confidence_score), 6) AS "min",
  round(max(confidence_score), 6) AS "max", round(stddev_pop(confidence_score), 6) AS std FROM results"""))
def confidence_summary(spark, sf_dir):
    c = assess.confidence_summary(results(spark, sf_dir))
    return c.select("count", *[_r(x).alias(x) for x in ("mean", "min", "max", "std")])


@query("confidence_by_day", o.with_(*_BASE, select="""
SELECT start_day, round(min(confidence_score), 6) AS "min", round(max(confidence_score), 6) AS "max"
FROM results GROUP BY start_day"""))
def confidence_by_day(spark, sf_dir):
    c = assess.confidence_by_day(results(spark, sf_dir))
    return c.select("start_day", _r("min").alias("min"), _r("max").alias("max"))


@query("confidence_by_class", o.with_(*_BASE, select=f"""
SELECT prediction, {_NAME.format('prediction')} AS predicted_label, count(*) AS "count",
  round(avg(confidence_score), 6) AS mean, round(min(confidence_score), 6) AS "min",
  round(max(confidence_score), 6) AS "max" FROM results GROUP BY prediction"""))
def confidence_by_class(spark, sf_dir):
    c = assess.confidence_by_class(results(spark, sf_dir))
    return c.select("prediction", "predicted_label", "count",
                    *[_r(x).alias(x) for x in ("mean", "min", "max")])


@query("predicted_distribution", o.with_(*_BASE, select=f"""
SELECT {_NAME.format('prediction')} AS predicted_label, count(*) AS "count",
  round(count(*)*100e0/sum(count(*)) OVER (), 6) AS percent FROM results GROUP BY prediction"""))
def predicted_distribution(spark, sf_dir):
    return assess.predicted_distribution(results(spark, sf_dir), top=10).withColumn(
        "percent", _r("percent"))


_ALPHA = f"[{', '.join(f'{a}e0' for a in ALPHA)}][true_label + 1]"
_P = f"greatest(least(probs[true_label + 1], {1 - PROB_EPSILON!r}), 1e-7)"


@query("focal_loss", o.with_(*_BASE, select=f"""
SELECT round(avg({_ALPHA} * pow(1 - {_P}, 2e0) * -ln({_P})), 6) AS loss FROM results"""))
def focal_loss(spark, sf_dir):
    return assess.focal_loss(results(spark, sf_dir), ALPHA).withColumn("loss", _r("loss"))


@query("focal_loss_smoothed", o.with_(*_BASE, select=f"""
SELECT round(avg({_ALPHA} * pow(1 - probs[true_label + 1], 2e0) * (
  {' + '.join(f"-((CASE WHEN true_label = {i} THEN 0.9e0 ELSE 0e0 END) + 0.1e0/7e0) * ln(probs[{i + 1}])" for i in range(7))})), 6)
  AS loss FROM results"""))
def focal_loss_smoothed(spark, sf_dir):
    return assess.focal_loss(results(spark, sf_dir), ALPHA, smoothing=0.1).withColumn(
        "loss", _r("loss"))


_TIMELINE = """
first_rows AS (SELECT pixel_id, start_day, prediction FROM results
  QUALIFY row_number() OVER (PARTITION BY pixel_id, start_day ORDER BY h, l_orderkey, l_partkey) = 1),
timeline AS (SELECT *, lag(prediction) OVER (PARTITION BY pixel_id ORDER BY start_day) AS previous FROM first_rows)"""


@query("prediction_timeline", o.with_(*_BASE, _TIMELINE, select="""
SELECT *, coalesce(previous <> prediction, false) AS changed FROM timeline"""))
def prediction_timeline(spark, sf_dir):
    return assess.prediction_timeline(results(spark, sf_dir), ["h", "l_orderkey", "l_partkey"])


@query("rotation_cycles", o.with_(*_BASE, _TIMELINE, select="""
SELECT pixel_id, string_agg(prediction::VARCHAR, '>' ORDER BY start_day) AS "sequence",
  count(*) FILTER (previous <> prediction) AS changes FROM timeline GROUP BY pixel_id"""))
def rotation_cycles(spark, sf_dir):
    return assess.rotation_cycles(
        assess.prediction_timeline(results(spark, sf_dir), ["h", "l_orderkey", "l_partkey"]))


@query("union_predictions", o.with_(*_BASE, select=" UNION ALL ".join(
    f"SELECT pixel_id, start_day, prediction, count(*) AS n FROM results WHERE start_day = {d} GROUP BY ALL"
    for d in (15, 45, 75, 105, 135, 165, 195))))
def union_predictions(spark, sf_dir):
    # All start days already live in one table: stacking batches is not a step.
    return results(spark, sf_dir).groupBy("pixel_id", "start_day", "prediction").agg(
        F.count(F.lit(1)).alias("n"))


_NO_TRUTH_CTES = [f"""
conf AS (SELECT avg(confidence_score) AS a, min(confidence_score) AS b, max(confidence_score) AS c,
  stddev_pop(confidence_score) AS d FROM results)""", f"""
dist AS (SELECT {_NAME.format('prediction')} AS nm, count(*) AS n, count(*)*100e0/sum(count(*)) OVER () AS p,
  avg(confidence_score) AS a, min(confidence_score) AS lo, max(confidence_score) AS hi
  FROM results GROUP BY prediction)""", """
days AS (SELECT start_day, min(confidence_score) AS lo, max(confidence_score) AS hi FROM results GROUP BY ALL)""", """
sorted_days AS (SELECT list_sort(list(start_day)) AS d FROM days)""", """
chosen AS (SELECT unnest(CASE WHEN len(d) >= 3 THEN [d[1], d[len(d)//2 + 1], d[len(d)]] ELSE d END) AS start_day
  FROM sorted_days)"""]
_NO_TRUTH = """
SELECT 'confidence' AS section, 'mean' AS item, a::DOUBLE AS "value" FROM conf
UNION ALL SELECT 'confidence', 'min', b FROM conf
UNION ALL SELECT 'confidence', 'max', c FROM conf UNION ALL SELECT 'confidence', 'std', d FROM conf
UNION ALL SELECT 'confidence_day', start_day::VARCHAR || ' min', lo FROM days
UNION ALL SELECT 'confidence_day', start_day::VARCHAR || ' max', hi FROM days
UNION ALL SELECT 'confidence_class', nm || ' count', n FROM dist
UNION ALL SELECT 'confidence_class', nm || ' mean', a FROM dist
UNION ALL SELECT 'confidence_class', nm || ' min', lo FROM dist
UNION ALL SELECT 'confidence_class', nm || ' max', hi FROM dist
UNION ALL SELECT 'predicted', nm || ' count', n FROM dist UNION ALL SELECT 'predicted', nm || ' percent', p FROM dist
UNION ALL SELECT 'representative', start_day::VARCHAR || ' start_day', start_day FROM chosen"""


@query("evaluate_predictions", o.with_(*_BASE, *_NO_TRUTH_CTES, select=f"""
SELECT section, item, round("value", 6) AS "value" FROM ({_NO_TRUTH})"""))
def evaluate_predictions(spark, sf_dir):
    """The report of a prediction table without truth."""
    return assess.evaluate_report(results(spark, sf_dir).drop("true_label")).withColumn(
        "value", _r("value"))


@query("evaluate_report", o.with_(*_BASE, _CLASS, _BY_DATE, f"""
rep AS ({_REPORT})""", *_NO_TRUTH_CTES, select=f"""
SELECT section, item, round("value", 6) AS "value" FROM ({_NO_TRUTH}
UNION ALL SELECT 'overall', 'accuracy', (sum(tp)/sum(support))::DOUBLE FROM prf
UNION ALL SELECT 'overall', 'micro_f1', sum(tp)/sum(support) FROM prf
UNION ALL SELECT 'overall', 'macro_f1', avg(f1) FROM prf
UNION ALL SELECT 'overall', 'weighted_f1', sum(f1*support)/sum(support) FROM prf
UNION ALL SELECT 'balanced', 'accuracy', avg(r) FROM (
  SELECT avg((true_label = prediction)::INTEGER) AS r FROM results GROUP BY true_label)
UNION ALL SELECT 'class', name || ' precision', "precision" FROM rep
UNION ALL SELECT 'class', name || ' recall', recall FROM rep
UNION ALL SELECT 'class', name || ' f1', f1 FROM rep
UNION ALL SELECT 'class', name || ' support', support FROM rep
UNION ALL SELECT 'matrix', true_label::VARCHAR || '>' || prediction::VARCHAR || ' count', count(*) FROM results
  GROUP BY true_label, prediction
UNION ALL SELECT 'date', prediction_date::VARCHAR || ' accuracy', accuracy FROM by_date
UNION ALL SELECT 'day', 'worst', (SELECT start_day FROM by_date ORDER BY accuracy, prediction_date LIMIT 1)
UNION ALL SELECT 'day', 'best', (SELECT start_day FROM by_date ORDER BY accuracy DESC, prediction_date LIMIT 1))"""))
def evaluate_report(spark, sf_dir):
    return assess.evaluate_report(results(spark, sf_dir)).withColumn("value", _r("value"))
