"""Assessment of scored tables.

A results row has pixel_id, start_day, true_label, probs, and after `predict`
also prediction, confidence_score and prediction_date. Every metric starts from a
count per (true, predicted) pair or another aggregate that combines on the map
side, so class sizes do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.constants import HIGH_CONFIDENCE, LEGEND, PROB_EPSILON
from fieldtide.functions import text, vectors
from fieldtide.session import durable


def _all():
    """Window over a whole report: one row per class, day or configuration."""
    return Window.partitionBy()


def predict(scores: DataFrame, year: int | Column, days_in_series: int) -> DataFrame:
    """Class, confidence and date of every scored row; the year may be a column."""
    year = F.lit(year) if isinstance(year, int) else year
    return scores.select(
        "*",
        vectors.argmax(F.col("probs")).alias("prediction"),
        F.array_max("probs").alias("confidence_score"),
        text.prediction_date(year, F.col("start_day"), days_in_series)
        .alias("prediction_date"),
    )


def label_names(results: DataFrame, legend: Sequence[str] = LEGEND) -> DataFrame:
    return results.withColumn(
        "predicted_label", vectors.name_of(F.col("prediction"), legend))


def harmonise(results: DataFrame) -> DataFrame:
    """Bring prediction-only tables to the column names of assessed tables."""
    renames = {"predicted_class": "prediction", "predicted_labels": "predicted_label"}
    return results.withColumnsRenamed({k: v for k, v in renames.items() if k in results.columns})


def summary_cube(results: DataFrame) -> DataFrame:
    """Counts and confidence moments per (day, true class if known, predicted class).

    Every number of the report follows from these cells, so one pass over the results and one
    small shuffle serve all of it. Spread is kept as squares around each cell's own mean, which
    keeps its digits when confidences lie close together.
    """
    c = F.col("confidence_score")
    truth = [t for t in ("true_label",) if t in results.columns]
    return results.groupBy("start_day", "prediction_date", *truth, "prediction").agg(
        F.count(F.lit(1)).alias("n"), F.count(c).alias("c_n"), F.avg(c).alias("c_mean"),
        (F.var_pop(c) * F.count(c)).alias("c_spread"), F.min(c).alias("c_min"), F.max(c).alias("c_max"))


def _rows(results: DataFrame) -> Column:
    """Number of rows: a sum over cube cells, or a count of plain rows."""
    return F.sum("n") if "n" in results.columns else F.count(F.lit(1))


def _mean_where(results: DataFrame, condition: Column) -> Column:
    if "n" in results.columns:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")
    return F.avg(condition.cast("int"))


def pair_counts(results: DataFrame) -> DataFrame:
    """Rows per (true_label, prediction)."""
    return results.groupBy("true_label", "prediction").agg(_rows(results).alias("count"))


def confusion_matrix(results: DataFrame, classes: int = len(LEGEND)) -> DataFrame:
    """One row per true class, one column per predicted class, zeros filled in."""
    ids = results.sparkSession.range(classes).select(F.col("id").cast("int").alias("true_label"))
    wide = results.groupBy("true_label").agg(*[
        F.count_if(F.col("prediction") == i).alias(f"pred_{i}") for i in range(classes)])
    return ids.join(wide, "true_label", "left").fillna(0)


def class_scores(results: DataFrame) -> DataFrame:
    """True positives, support, predictions, precision, recall and F1 per class.

    Covers every class seen in truth or prediction; ratios without a denominator
    are zero.
    """
    sides = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("count").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("true_label") == F.col("prediction"), F.col("count"))
                 .otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))
    per_class = (
        pair_counts(results).select(F.inline(sides))
        .groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"),
                              F.sum("predicted").alias("predicted"))
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return (
        per_class
        .withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", ratio(F.col("tp") * 2.0, F.col("support") + F.col("predicted")))
    )


def overall_metrics(results: DataFrame) -> DataFrame:
    """Accuracy with micro, macro and weighted F1."""
    weighted = F.sum(F.col("f1") * F.col("support")) / F.sum("support")
    accuracy = F.sum("tp") / F.sum("support")
    return class_scores(results).agg(
        accuracy.alias("accuracy"), accuracy.alias("micro_f1"),
        F.avg("f1").alias("macro_f1"), weighted.alias("weighted_f1"))


def classification_report(results: DataFrame, legend: Sequence[str] = LEGEND) -> DataFrame:
    """Per class rows, then accuracy-free macro and weighted averages."""
    per_class = class_scores(results)
    rows = per_class.select(
        vectors.name_of(F.col("label"), legend).alias("name"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    averages = per_class.agg(
        total.alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}")
          for m in ("precision", "recall", "f1")])
    kinds = F.array(*[
        F.struct(F.lit(f"{k} avg").alias("name"), F.col(f"{k}_precision").alias("precision"),
                 F.col(f"{k}_recall").alias("recall"), F.col(f"{k}_f1").alias("f1"),
                 F.col("support").alias("support"))
        for k in ("macro", "weighted")])
    return rows.unionByName(averages.select(F.inline(kinds)))


def balanced_accuracy(results: DataFrame, legend: Sequence[str] = LEGEND) -> DataFrame:
    """Recall per class present in the truth, with their mean."""
    return class_scores(results).where(F.col("support") > 0).select(
        vectors.name_of(F.col("label"), legend).alias("name"), "recall",
        F.avg("recall").over(_all()).alias("balanced_accuracy"))


def weighted_prf(results: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1."""
    total = F.sum("support")
    return class_scores(results).agg(*[
        (F.sum(F.col(m) * F.col("support")) / total).alias(m) for m in ("precision", "recall", "f1")])


def accuracy_by_date(results: DataFrame) -> DataFrame:
    """Accuracy per prediction date; pairs are counted, rows are never gathered."""
    return results.groupBy("prediction_date", "start_day").agg(
        _rows(results).alias("rows"),
        _mean_where(results, F.col("true_label") == F.col("prediction")).alias("accuracy"))


def accuracy_on(results: DataFrame, start_days: Sequence[int]) -> DataFrame:
    """Accuracy of given start days, 0.0 where a day has no rows."""
    days = results.sparkSession.createDataFrame([(d,) for d in start_days], "start_day int")
    return days.join(
        accuracy_by_date(results.where(F.col("start_day").isin(list(start_days)))),
        "start_day", "left",
    ).select("start_day", F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def best_worst_day(results: DataFrame) -> DataFrame:
    """Start days of lowest and highest accuracy; the first date wins ties."""
    day = F.col("prediction_date")
    return accuracy_by_date(results).agg(
        F.min_by("start_day", F.struct("accuracy", day)).alias("worst_start_day"),
        F.max_by("start_day", F.struct("accuracy", -F.unix_date(day))).alias("best_start_day"),
        F.min("accuracy").alias("worst_accuracy"), F.max("accuracy").alias("best_accuracy"))


def representative_days(results: DataFrame) -> DataFrame:
    """First, middle and last start day; every day when there are fewer than three."""
    days = results.select("start_day").distinct().agg(
        F.sort_array(F.collect_list("start_day")).alias("d"))
    n = F.size("d")
    three = F.array(F.get("d", F.lit(0)), F.get("d", F.floor(n / 2).cast("int")),
                    F.get("d", n - 1))
    return days.select(F.explode(F.when(n >= 3, three).otherwise(F.col("d"))).alias("start_day"))


def snapshot(results: DataFrame, start_days: Sequence[int]) -> DataFrame:
    """Results of chosen start days with their date: the frame behind a map."""
    return results.where(F.col("start_day").isin(list(start_days)))


def _confidence(*extra: Column) -> list[Column]:
    c = F.col("confidence_score")
    return [F.count(c).alias("count"), F.avg(c).alias("mean"), F.min(c).alias("min"),
            F.max(c).alias("max"), *extra]


def _cube_mean() -> Column:
    return F.sum(F.col("c_mean") * F.col("c_n")) / F.sum("c_n")


def _cube_confidence(*extra: Column) -> list[Column]:
    return [F.sum("c_n").alias("count"), _cube_mean().alias("mean"), F.min("c_min").alias("min"),
            F.max("c_max").alias("max"), *extra]


def confidence_summary(results: DataFrame) -> DataFrame:
    if "n" not in results.columns:
        return results.agg(*_confidence(F.stddev_pop("confidence_score").alias("std")))
    mean = F.sum(F.col("c_mean") * F.col("c_n")).over(_all()) / F.sum("c_n").over(_all())
    apart = F.col("c_spread") + F.col("c_n") * F.pow(F.col("c_mean") - F.col("_m"), F.lit(2))
    return results.withColumn("_m", mean).agg(
        *_cube_confidence(F.sqrt(F.sum(apart) / F.sum("c_n")).alias("std")))


def confidence_by_day(results: DataFrame) -> DataFrame:
    low, high = ("c_min", "c_max") if "n" in results.columns else ("confidence_score",) * 2
    return results.groupBy("start_day").agg(F.min(low).alias("min"), F.max(high).alias("max"))


def confidence_by_class(results: DataFrame, legend: Sequence[str] = LEGEND) -> DataFrame:
    """Confidence per predicted class, only classes seen, in legend order."""
    columns = _cube_confidence() if "n" in results.columns else _confidence()
    return (
        results.groupBy("prediction").agg(*columns)
        .withColumn("predicted_label", vectors.name_of(F.col("prediction"), legend))
        .orderBy("prediction")
    )


def predicted_distribution(
    results: DataFrame, legend: Sequence[str] = LEGEND, top: int | None = None,
) -> DataFrame:
    """Count and percentage per predicted label, largest first."""
    counts = results.groupBy("prediction").agg(_rows(results).alias("count")).select(
        vectors.name_of(F.col("prediction"), legend).alias("predicted_label"), "count",
        (F.col("count") * 100.0 / F.sum("count").over(_all())).alias("percent"),
    ).orderBy(F.desc("count"), "predicted_label")
    return counts if top is None else counts.limit(top)


def high_confidence(results: DataFrame, threshold: float = HIGH_CONFIDENCE) -> DataFrame:
    """How many predictions are sure, and their share."""
    sure = F.count_if(F.col("confidence_score") >= threshold)
    return results.agg(
        sure.alias("sure"), F.count(F.lit(1)).alias("total"),
        (sure * 100.0 / F.count(F.lit(1))).alias("percent"))


def focal_loss(
    results: DataFrame,
    alpha: Sequence[float] | float = 0.25,
    gamma: float = 2.0,
    smoothing: float | None = None,
    classes: int = len(LEGEND),
) -> DataFrame:
    """Mean focal loss of stored class probabilities.

    Per class form: alpha of the true class times sum over classes of
    (1 - p)^gamma * (-y ln p), p clipped. With `smoothing` the cross entropy is
    taken against smoothed targets and focused by the probability of the truth.
    """
    weights = [alpha] * classes if isinstance(alpha, float) else list(alpha)
    truth = F.col("true_label")
    a = F.get(F.array(*map(F.lit, weights)), truth)
    clip = lambda p: F.greatest(F.least(p, F.lit(1 - PROB_EPSILON)), F.lit(PROB_EPSILON))
    if smoothing is None:
        # every class but the true one has y = 0 and adds nothing
        p = clip(F.get("probs", truth))
        loss = a * F.pow(1 - p, F.lit(gamma)) * -F.ln(p)
    else:
        y = lambda i: F.when(i == truth, 1.0).otherwise(0.0) * (1 - smoothing) + smoothing / classes
        terms = F.transform("probs", lambda p, i: -y(i) * F.ln(clip(p)))
        entropy = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)
        loss = a * F.pow(1 - F.get("probs", truth), F.lit(gamma)) * entropy
    return results.agg(F.avg(loss).alias("loss"))


def prediction_timeline(results: DataFrame, order: Sequence[str]) -> DataFrame:
    """Predicted class per pixel over the start days, with change points.

    Repeated (pixel, start_day) rows are reduced to one by `order` first, which
    combines on the map side; a pixel then has at most one row per start day.
    """
    first = results.groupBy("pixel_id", "start_day").agg(
        F.min_by("prediction", F.struct(*order)).alias("prediction"))
    over = Window.partitionBy("pixel_id").orderBy("start_day")
    previous = F.lag("prediction").over(over)
    return first.select(
        "pixel_id", "start_day", "prediction", previous.alias("previous"),
        F.coalesce(previous != F.col("prediction"), F.lit(False)).alias("changed"))


def rotation_cycles(timeline: DataFrame) -> DataFrame:
    """Class sequence and number of changes per pixel (one entry per start day)."""
    step = F.struct("start_day", "prediction")
    return timeline.groupBy("pixel_id").agg(
        F.array_join(F.transform(
            F.sort_array(F.collect_list(step)), lambda s: s["prediction"].cast("string")), ">")
        .alias("sequence"),
        F.count_if("changed").alias("changes"))


def evaluate_report(results: DataFrame) -> DataFrame:
    """All headline numbers as (section, item, value) rows.

    A table without true_label (predictions only) gets the sections that need no truth:
    predicted classes, confidence in all, by day and by class, and representative days.
    """

    def long(df: DataFrame, section: str, item: Column, **values: str) -> DataFrame:
        table = F.array(*[
            F.struct(F.concat_ws(" ", item, F.lit(k)).alias("item"),
                     F.col(c).cast("double").alias("value")) for k, c in values.items()])
        return df.select(F.lit(section).alias("section"), F.inline(table))

    known = "true_label" in results.columns
    results = durable(summary_cube(results))
    none, day = F.lit(None).cast("string"), F.col("start_day").cast("string")
    parts = [
        long(confidence_summary(results), "confidence", none, mean="mean", min="min", max="max",
             std="std"),
        long(confidence_by_day(results), "confidence_day", day, min="min", max="max"),
        long(confidence_by_class(results), "confidence_class", F.col("predicted_label"),
             count="count", mean="mean", min="min", max="max"),
        long(predicted_distribution(results), "predicted", F.col("predicted_label"),
             count="count", percent="percent"),
        long(representative_days(results), "representative", day, start_day="start_day"),
    ]
    if known:
        pair = F.concat_ws(">", F.col("true_label").cast("string"), F.col("prediction").cast("string"))
        parts += [
            long(overall_metrics(results), "overall", none, accuracy="accuracy",
                 micro_f1="micro_f1", macro_f1="macro_f1", weighted_f1="weighted_f1"),
            long(balanced_accuracy(results).select("balanced_accuracy").limit(1), "balanced", none,
             accuracy="balanced_accuracy"),
            long(classification_report(results), "class", F.col("name"), precision="precision",
                 recall="recall", f1="f1", support="support"),
            long(pair_counts(results), "matrix", pair, count="count"),
            long(accuracy_by_date(results), "date", F.col("prediction_date").cast("string"),
                 accuracy="accuracy"),
            long(best_worst_day(results), "day", none, worst="worst_start_day",
                 best="best_start_day"),
        ]
    report = parts[0]
    for part in parts[1:]:
        report = report.unionByName(part)
    return report
