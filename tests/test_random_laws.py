"""Seeded draws follow the laws they stand for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtide.operators import augment, sampling


def draws(spark, column, n=40_000):
    rows = spark.range(n).select(F.xxhash64("id").bitwiseAND(F.lit((1 << 32) - 1)).alias("h"))
    return np.array([r[0] for r in rows.select(column).collect()])


def lag(x, y):
    return abs(np.corrcoef(x, y)[0, 1])


def test_uniform_draws_are_independent(spark):
    u = [draws(spark, augment.uniform(F.col("h"), i)) for i in (0, 1, 7)]
    for x in u:
        assert abs(x.mean() - 0.5) < 0.01 and abs(x.std() - math.sqrt(1 / 12)) < 0.005
        assert np.abs(np.quantile(x, [0.1, 0.5, 0.9]) - [0.1, 0.5, 0.9]).max() < 0.01
    assert max(lag(u[0], u[1]), lag(u[1], u[2]), lag((u[0] - 0.5) ** 2, (u[1] - 0.5) ** 2)) < 0.02
    assert np.abs((u[1] - u[0]) % 1 - 0.178).min() < 1e-3 and np.std((u[1] - u[0]) % 1) > 0.25


def test_normal_draws(spark):
    z, y = (draws(spark, augment.normal(F.col("h"), i)) for i in (3, 4))
    assert abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02 and lag(z, y) < 0.02
    assert abs((z**3).mean()) < 0.06 and abs((z**4).mean() - 3) < 0.15
    want = [-2.3263, -1.2816, 0.0, 1.2816, 2.3263]
    assert np.abs(np.quantile(z, [0.01, 0.1, 0.5, 0.9, 0.99]) - want).max() < 0.06
    assert z.min() < -3.3 and z.max() > 3.3


@pytest.mark.parametrize("alpha", [0.2, 0.4, 0.9])
def test_beta_draws(spark, alpha):
    w = draws(spark, augment.beta_draw(F.col("h"), alpha), 20_000)
    assert abs(w.mean() - 0.5) < 0.01 and abs(w.var() - 1 / (4 * (2 * alpha + 1))) < 0.004
    rng = np.random.default_rng(0).beta(alpha, alpha, 400_000)
    at = [0.05, 0.25, 0.5, 0.75, 0.95]
    # compare on the scale of probabilities, where the tails do not blow up
    assert np.abs([(rng <= q).mean() for q in np.quantile(w, at)] - np.array(at)).max() < 0.012


def test_beta_quantile_solves_its_equation(spark):
    a, us = 0.4, [1e-9, 0.01, 0.2, 0.5, 0.77, 0.999]
    rows = spark.createDataFrame([(u,) for u in us], "u double").select(augment.beta_quantile(F.col("u"), a)).collect()
    for u, (x,) in zip(us, rows):
        t = np.linspace(0, min(x, 1 - x) ** a, 200_001)  # the integral after t = x^a
        f = (1 - t ** (1 / a)) ** (a - 1) / a / (math.gamma(a) ** 2 / math.gamma(2 * a))
        assert math.isclose(np.trapezoid(f, t), min(u, 1 - u), rel_tol=1e-6)


def test_repeated_keys_are_an_error(spark):
    rows = spark.range(20).selectExpr("id % 19 AS k", "id AS v")
    with pytest.raises(Exception, match="same hash and ties"):
        sampling.shuffle_batches(rows, F.xxhash64("k"), ["k"], 5).collect()
    whole = sampling.shuffle_batches(spark.range(20).selectExpr("id AS k"), F.xxhash64("k"), ["k"], 6).collect()
    assert sorted(r.batch_id for r in whole) == [0] * 6 + [1] * 6 + [2] * 6 + [3] * 2


def test_partners_are_a_permutation_of_the_batch(spark):
    rows = spark.range(90).selectExpr(
        "id", "id div 30 AS batch_id", "array(cast(id AS float)) AS features", "array(cast(1 AS float)) AS one_hot")
    out = augment.mixup(rows, F.xxhash64("id"), F.xxhash64("id", F.lit(1)), lam=0.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for batch in range(3):
        got = out.where(F.col("batch_id") == batch).collect()
        assert sorted(r.features[0] for r in got) == list(range(30 * batch, 30 * batch + 30))
        assert sorted(r.position for r in got) == list(range(1, 31)) and {r.one_hot[0] for r in got} == {1.0}
        assert any(r.features[0] != r.id for r in got)
