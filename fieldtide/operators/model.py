"""Training and scoring as Spark jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldtide.constants import CHANNELS, LEGEND
from fieldtide.functions import vectors
from fieldtide.sources.sinks import replace_partitions


def classifier(name: str, width: int, classes: int = len(LEGEND), seed: int = 42):
    """Estimator by name; an unknown name is an error."""
    common = {"featuresCol": "vector", "labelCol": "label"}
    makers = {
        "logistic": lambda: LogisticRegression(maxIter=20, regParam=0.01, **common),
        "forest": lambda: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, **common),
        "perceptron": lambda: MultilayerPerceptronClassifier(
            layers=[width, 32, classes], maxIter=20, seed=seed, **common),
    }
    if name not in makers:
        raise ValueError(f"unknown model {name}; known: {', '.join(sorted(makers))}")
    return makers[name]()


def train_classifier(examples: DataFrame, name: str, width: int) -> PipelineModel:
    """Fit on (features, label). The rows should be stored: fitting reads them repeatedly."""
    rows = examples.select(array_to_vector("features").alias("vector"), "label")
    return Pipeline(stages=[classifier(name, width)]).fit(rows)


def score(model: PipelineModel, examples: DataFrame, classes: int = len(LEGEND)) -> DataFrame:
    """Examples with `probs`, one entry per legend class; the model runs once per row."""
    scored = model.transform(examples.withColumn("vector", array_to_vector("features")))
    full = vectors.let(vector_to_array("probability"), lambda probs: F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.get(probs, i), F.lit(0.0))))
    return scored.withColumn("probs", full).drop(
        "vector", "rawPrediction", "probability", "prediction")


def score_external(
    examples: DataFrame, predict: Callable, keep: Sequence[str], output: str = "probs",
) -> DataFrame:
    """Score with any model: `predict` maps a float matrix to one row of numbers per example.

    Batches arrive by Arrow in the task that holds the rows; the batch length is
    spark.sql.execution.arrow.maxRecordsPerBatch, which bounds the memory of a call.
    """
    schema = examples.select(*keep).schema.add(output, T.ArrayType(T.DoubleType()))

    def batches(records):
        import numpy as np
        import pyarrow as pa

        for record in records:
            n = record.num_rows
            if n:
                # one flat buffer, no row objects
                matrix = record.column(len(keep)).flatten().to_numpy().reshape(n, -1)
                found = np.asarray(predict(matrix), dtype="float64").reshape(n, -1)
                ends = np.arange(n + 1, dtype="int32") * found.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*record.columns[:len(keep)], lists], [*keep, output])

    return examples.select(*keep, "features").mapInArrow(batches, schema)


def class_centroids(rows: DataFrame) -> DataFrame:
    """Mean of the non-zero values per (label, bucket) and channel: one small table."""
    return rows.groupBy("label", "bucket").agg(*[
        F.avg(F.when(F.col(c) != 0, F.col(c).cast("double"))).alias(f"m_{c}") for c in CHANNELS])


def centroid_model(centroids: DataFrame, buckets: int, labels: int = len(LEGEND)) -> Callable:
    """Distance function of a centroid table (labels x buckets rows, like any weights).

    A row beyond the given sizes is an error.

    The distance of a window to a class is the mean squared gap over the values
    both have; it is infinite where they share none.
    """
    import numpy as np

    means = np.full((labels, buckets, len(CHANNELS)), np.nan)
    for row in centroids.collect():
        if not (0 <= row["label"] < labels and 0 <= row["bucket"] < buckets):
            raise ValueError(f"centroid outside {labels} labels x {buckets} buckets: {row}")
        means[row["label"], row["bucket"]] = [
            np.nan if row[f"m_{c}"] is None else row[f"m_{c}"] for c in CHANNELS]
    means = means.reshape(labels, -1)
    known = (~np.isnan(means)).astype("float64")
    count = known.sum(axis=0)
    centre = np.where(count > 0, np.nansum(means, axis=0) / np.maximum(count, 1), 0.0)
    moved = np.where(known > 0, np.nan_to_num(means) - centre, 0.0)

    def distances(matrix):
        raw = np.asarray(matrix, dtype="float64")
        seen = (raw != 0).astype("float64")
        # around the centre of the means the expanded square keeps its digits
        x = np.where(raw != 0, raw - centre, 0.0)
        shared = seen @ known.T
        gap = (x * x) @ known.T - 2 * x @ moved.T + seen @ (moved * moved).T
        return np.where(shared > 0, gap / np.maximum(shared, 1), np.inf)

    return distances


def centroid_score(
    examples: DataFrame, centroids: DataFrame, buckets: int, keep: Sequence[str],
) -> DataFrame:
    """Nearest class mean of each window; windows without any shared value are left out."""
    scored = score_external(examples, centroid_model(centroids, buckets), keep, "distances")
    nearest = F.array_min("distances")
    return scored.where(nearest < float("inf")).select(
        *keep, (F.array_position("distances", nearest) - 1).cast("int").alias("prediction"),
        nearest.alias("distance"))


def finished_days(spark, root: str) -> list[int]:
    """Start days already stored (partition values of the result table)."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(root)
    except AnalysisException:
        return []
    return sorted(r[0] for r in stored.select("start_day").distinct().collect())


#: Start days of one commit: what a crash can cost.
DAYS_PER_COMMIT = 5


def resume_sweep(
    spark, root: str, days: Sequence[int], score_days: Callable[[list[int]], DataFrame],
    per_commit: int = DAYS_PER_COMMIT,
) -> DataFrame:
    """Score the start days that are not stored yet and return the whole result table.

    Every `per_commit` days are one job and one commit. Results are partitioned by start_day and
    replaced per partition, so a run that stopped half-way keeps its finished groups and is
    continued by running it again.
    """
    done = set(finished_days(spark, root))
    todo = [d for d in days if d not in done]
    for at in range(0, len(todo), per_commit):
        replace_partitions(score_days(todo[at:at + per_commit]), root, ["start_day"])
    return spark.read.parquet(root)

