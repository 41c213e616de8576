"""Augmentation of example tables (features: flat array of numbers, steps x width).

Draws come from a seeded hash of the row or batch, so a task that runs again
after a lost executor produces the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.functions import text, vectors

#: Terms and steps of the Beta quantile; both errors are below 1e-12 for alpha < 1.
BETA_TERMS, BETA_STEPS = 40, 40


def _digest(h: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.md5(F.concat_ws("|", h.cast("string"), i.cast("string")))


def _unit(digest: Column, first: int) -> Column:
    """Number in (0, 1) from 13 hex digits (52 bits) of a digest."""
    whole = F.conv(F.substring(digest, first, 13), 16, 10).cast("bigint")
    return (whole.cast("double") + 0.5) / float(1 << 52)


def uniform(h: Column, i: Column | int = 0) -> Column:
    """Uniform number in (0, 1); every draw index is hashed by itself, so draws are independent."""
    return _unit(_digest(h, i), 1)


def normal(h: Column, i: Column | int) -> Column:
    """Standard normal draw (Box-Muller on two separate parts of one digest)."""
    return vectors.let(_digest(h, i), lambda d: (
        F.sqrt(F.ln(_unit(d, 1)) * -2) * F.cos(_unit(d, 14) * (2 * math.pi))))


def batch_hash(seed: int = 42) -> Column:
    return text.seeded_hash(F.lit("batch"), F.col("batch_id"), seed=seed)


def jitter_scale(
    examples: DataFrame, row_hash: Column, sigma: float = 0.01,
    low: float = 0.9, high: float = 1.1, seed: int = 42,
) -> DataFrame:
    """Gaussian noise on every feature and one scale factor per batch."""
    factor = uniform(batch_hash(seed)) * (high - low) + low
    draw = F.struct(row_hash.alias("h"), factor.alias("f"))
    return examples.withColumn("features", vectors.let(draw, lambda d: F.transform(
        "features", lambda x, i: (
            (x.cast("double") + normal(d["h"], i) * sigma) * d["f"]).cast("float"))))


def beta_terms(alpha: float) -> list[float]:
    """Coefficients of the series I_x(a, a) B(a, a) = x^a (c0 + c1 x + c2 x^2 + ...)."""
    out, rising = [], 1.0
    for n in range(BETA_TERMS):
        out.append(rising / (alpha + n))
        rising *= (1 - alpha + n) / (n + 1)
    return out


def beta_quantile(u: Column, alpha: float) -> Column:
    """Value below which a symmetric Beta(alpha, alpha) draw falls with probability u, alpha < 1.

    The law is symmetric, so the series is only needed up to 1/2, where it converges fast. The
    equation is solved for its leading power by fixed-point steps that shrink the error to less
    than half each. Every draw costs the same; none is rejected.
    """
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    beta = math.gamma(alpha) ** 2 / math.gamma(2 * alpha)
    terms = F.array(*[F.lit(c) for c in reversed(beta_terms(alpha))])
    series = lambda x: F.aggregate(terms, F.lit(0.0), lambda acc, c: acc * x + c)
    half = F.least(u, 1 - u)

    def solve(target: Column) -> Column:
        first = F.pow(target * alpha, F.lit(1 / alpha))
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(BETA_STEPS)), F.least(first, F.lit(0.5)),
            lambda x, _: F.least(F.pow(target / series(x), F.lit(1 / alpha)), F.lit(0.5)))

    small = vectors.let(half * beta, solve)
    return F.when(u <= 0.5, small).otherwise(1 - small)


def beta_draw(h: Column, alpha: float) -> Column:
    """Symmetric Beta(alpha, alpha) draw, the law of g1 / (g1 + g2) for gamma(alpha) draws."""
    return beta_quantile(uniform(h), alpha)


def mixup(
    examples: DataFrame, row_hash: Column, partner_hash: Column,
    lam: float | None = None, alpha: float = 0.4, seed: int = 42,
) -> DataFrame:
    """Mix each example with a shuffled one of its batch; one weight per batch.

    Positions inside a batch come from one hash, partners from another. A batch has a fixed size,
    so it is gathered once, put into both orders there, and its rows leave with their partners:
    one exchange of the rows and no join.
    """
    columns = [c for c in examples.columns if c != "batch_id"]
    gathered = examples.groupBy("batch_id").agg(F.collect_list(F.struct(
        row_hash.alias("_h1"), partner_hash.alias("_h2"), F.struct(*columns).alias("row"))).alias("rows"))
    placed = F.sort_array("rows")
    partners = F.sort_array(F.transform("rows", lambda r: F.struct(
        r["_h2"].alias("_h2"), r["_h1"].alias("_h1"), r["row"]["features"].alias("_x2"), r["row"]["one_hot"].alias("_y2"))))
    pairs = F.transform(F.arrays_zip(placed.alias("a"), partners.alias("b")), lambda p, i: F.struct(
        p["a"]["row"].alias("row"), p["b"]["_x2"].alias("_x2"), p["b"]["_y2"].alias("_y2"), (i + 1).alias("position")))
    weight = F.lit(lam) if lam is not None else beta_draw(batch_hash(seed), alpha)
    blend = lambda a, b: F.zip_with(a, b, lambda x, y: (
        F.col("weight") * x.cast("double") + (1 - F.col("weight")) * y.cast("double")).cast("float"))
    return (
        gathered.select("batch_id", F.inline(pairs)).select("batch_id", "row.*", "position", "_x2", "_y2")
        .withColumn("weight", weight).withColumn("features", blend("features", "_x2"))
        .withColumn("one_hot", blend("one_hot", "_y2")).drop("_x2", "_y2")
    )


def time_channel(examples: DataFrame, steps: int, width: int) -> DataFrame:
    """Append a channel that runs from 0 to 1 over the time steps."""
    def rows(features: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.concat(
            F.slice(features, i * width + 1, F.lit(width)),
            F.array(i / (steps - 1))))

    return examples.withColumn("features", F.flatten(vectors.let(F.col("features"), rows)))


def batch_shift(seed: int = 42) -> Column:
    """One shift in -2..1 per batch."""
    return (F.floor(uniform(batch_hash(seed), 1) * 4) - 2).cast("int")


def time_roll(examples: DataFrame, shift: Column, steps: int, width: int) -> DataFrame:
    """Circular shift of the time axis: step t moves to t + shift."""
    cut = F.pmod(-shift, F.lit(steps)) * width
    rolled = lambda f: F.concat(
        F.slice(f, cut + 1, F.lit(steps * width) - cut), F.slice(f, F.lit(1), cut))
    return examples.withColumn("features", vectors.let(F.col("features"), rolled))
