"""Fitted models: optimal where they should be, run once per row, and whole in the sweep."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldtide.constants import LEGEND, SWEEP_START_DAYS
from fieldtide.functions import vectors
from fieldtide.operators import model


@pytest.fixture(scope="module")
def examples(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 6)) * [1, 2, 0.5, 3, 1, 1] + 1
    label = (x @ rng.normal(size=(6, 3)) + rng.gumbel(size=(600, 3))).argmax(axis=1)
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(600)]
    return spark.createDataFrame(rows, "id long, features array<float>, label int").cache()


def test_logistic_model_is_optimal(examples):
    """The gradient of the mean loss plus the ridge (on standardised features) is zero."""
    estimator = model.classifier("logistic", 6).setMaxIter(500).setTol(1e-12)
    fitted = Pipeline(stages=[estimator]).fit(examples.select(array_to_vector("features").alias("vector"), "label"))
    rows = model.score(fitted, examples, 3).select("features", "label", "probs").collect()
    x = np.array([r.features for r in rows])
    y, p = np.eye(3)[[r.label for r in rows]], np.array([r.probs for r in rows])
    scale = x.std(axis=0, ddof=1)
    w = fitted.stages[0].coefficientMatrix.toArray()
    gradient = (p - y).T @ (x / scale) / len(x) + 0.01 * w * scale
    assert np.abs(gradient).max() < 1e-5 and np.abs((p - y).mean(axis=0)).max() < 1e-6


@pytest.mark.parametrize("name", ["logistic", "forest", "perceptron"])
def test_models_beat_the_majority_on_rows_they_have_not_seen(examples, name):
    train, val = examples.where("id % 4 > 0"), examples.where("id % 4 = 0")
    fitted = Pipeline(stages=[model.classifier(name, 6, 3)]).fit(
        train.select(array_to_vector("features").alias("vector"), "label"))
    scored = model.score(fitted, val, 3).withColumn("prediction", vectors.argmax(F.col("probs"))).collect()
    right = sum(r.prediction == r.label for r in scored) / len(scored)
    most = max(np.bincount([r.label for r in scored])) / len(scored)
    assert right > most + 0.1
    assert all(abs(sum(r.probs) - 1) < 1e-9 for r in scored)


def test_forest_splits_lower_the_impurity(examples):
    fitted = model.train_classifier(examples, "forest", 6)
    for tree in fitted.stages[0].trees:
        node, stack = None, [tree._call_java("rootNode")]
        while stack:
            node = stack.pop()
            if node.subtreeDepth() > 0:
                left, right = node.leftChild(), node.rightChild()
                share = left.impurityStats().count() / node.impurityStats().count()
                after = share * left.impurity() + (1 - share) * right.impurity()
                assert after < node.impurity() + 1e-12
                stack += [left, right]


def test_model_runs_once_per_row(examples):
    fitted = model.train_classifier(examples, "forest", 6)
    scored = model.score(fitted, examples).select("id", vectors.argmax(F.col("probs")).alias("prediction"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(features") + plan.count("UDF(cast(features") <= 1, plan
    assert scored.count() == 600


def test_missing_classes_have_no_probability(examples):
    fitted = model.train_classifier(examples, "logistic", 6)
    assert {len(r.probs) for r in model.score(fitted, examples, 5).collect()} == {5}
    assert {sum(r.probs[3:]) for r in model.score(fitted, examples, 5).collect()} == {0.0}


def test_sweep_is_whole(spark, sf_dir, duck):
    rows = entry.queries()["score_sweep"](spark, sf_dir).collect()
    got = {}
    for r in rows:
        got[r.start_day, r.true_label] = got.get((r.start_day, r.true_label), 0) + 1
        assert r.predicted_label == LEGEND[r.prediction] and 1 / len(LEGEND) - 1e-6 <= r.confidence_score <= 1
    want = {(d, label): n for d, label, n in duck.sql(entry.oracle_sql()["resume_sweep"]).fetchall()}
    assert got == want and {d for d, _ in got} == set(SWEEP_START_DAYS)
    keys = {(r.bbox, r.year, r.lon, r.lat, r.start_day) for r in rows}
    assert len(keys) == len(rows)


def test_training_query_is_judged_on_later_years(spark, sf_dir, duck):
    rows = entry.queries()["train_classifier"](spark, sf_dir).collect()
    held = duck.sql(entry.oracle_sql()["label_counts"].replace("SELECT label, count(*)", "SELECT label, count(*) FILTER (\"year\" >= 1999)")).fetchall()
    got = {}
    for r in rows:
        got[r.label] = got.get(r.label, 0) + r["count"]
    assert got == {label: n for label, n in held if n}
