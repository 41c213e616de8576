"""URL filters: rules first, then the ratio of two character language models.

URLs that a rule decides are the labelled ones, all of them. Two variable-order Markov models over
their characters, one for accepted and one for rejected URLs, are smoothed by interpolating every
order with the next lower one (Witten-Bell). A URL without a rule is judged by the difference of
its log-likelihoods per character against a threshold calibrated on labelled URLs kept apart.

A character and its ORDER predecessors fill 48 bits, so counts are a table of numbers. Spark adds
up the lower orders from it and joins every order with the next lower one; a key has at most
ALPHABET partners there. What the URLs to be judged ask for becomes one gain for each such number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import stored, unit_hash

# The rules, (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
ORDER = 5  # characters of context at most
CALIBRATED = 0.25  # share of the labelled URLs kept apart for the threshold
ALPHABET = 256  # characters are bytes of UTF-8
FREQUENT = 1 << 19  # gains that go to the tasks, at most; rarer ones are joined
BINS = 4096  # of the calibration histogram, for each unit of score
LIMIT = 8  # scores beyond it share the last bin
PIECE = 1 << 20  # bytes of URLs that are looked at in one piece


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first :// and / ? # or the end, A-Z lowered; from there to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.char_length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for own_host, own_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == own_host) | host.endswith(f".{own_host}")) & path.startswith(own_path)
        rule = F.when(fits, F.lit(own_host + own_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _pieces(urls: list[str | None]) -> Iterator[list[bytes]]:
    """URLs in UTF-8 (null: empty) in lists of about PIECE bytes."""
    held, size = [], 0
    for url in urls:
        held.append((url or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + ORDER + 1
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grams(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every character (the end mark too) with its ORDER predecessors as one number; URL of each.

    Digits are one digit, and ORDER start marks stand before each URL.
    """
    parts = [b"\x02" * ORDER + u + b"\x03" for u in urls]
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    data = np.where((data >= 48) & (data <= 57), 48, data).astype(np.int64)
    lengths = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), lengths)
    at = np.flatnonzero(np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths) >= ORDER)
    gram = np.zeros(len(at), dtype=np.int64)
    for back in range(ORDER, -1, -1):
        gram = (gram << 8) | data[at - back]
    return gram, owner[at]


def gram_counts(urls: DataFrame) -> DataFrame:
    """urls (url, side) -> (gram, accepted, rejected, asked): how often the URLs of each side hold it.

    Counted in every task before the shuffle, so frequent ones are one row of a task.
    """
    sides = ("accepted", "rejected", "asked")

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            side_of = np.array(batch.column(1).to_pylist(), dtype=object)
            for side in sides:
                for piece in _pieces(batch.column(0).filter(pa.array(side_of == side, pa.bool_())).to_pylist()):
                    grams, n = np.unique(_grams(piece)[0], return_counts=True)
                    own = [n if s == side else np.zeros_like(n) for s in sides]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (grams, *own)], ["gram", *sides])

    return (
        urls.select("url", "side").mapInArrow(each, "gram long, accepted long, rejected long, asked long")
        .groupBy("gram").agg(*[F.sum(s).alias(s) for s in sides])
    )


def gains(counts: DataFrame) -> DataFrame:
    """counts (of gram_counts) -> (gram, asked, gain) of all grams that are asked for.

    gain: difference of the logarithms of both models' interpolated probabilities.
    """
    sides = ("accepted", "rejected")
    orders = {ORDER: counts}
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        orders[k] = orders[k + 1].groupBy(shorter.alias("gram")).agg(
            *[F.sum(s).alias(s) for s in (*sides, "asked")])
    lower = None
    for k in range(ORDER + 1):
        now = orders[k].withColumn("context", F.shiftright("gram", 8))
        contexts = now.groupBy("context").agg(
            *[F.sum(s).alias(f"{s}_n") for s in sides], *[F.count_if(F.col(s) > 0).alias(f"{s}_kinds") for s in sides])
        now = now.join(contexts, "context")
        if k:
            now = now.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(lower, "shorter")
        below = {s: F.col(f"{s}_below") if k else F.lit(1.0 / ALPHABET) for s in sides}
        p = [F.when(F.col(f"{s}_n") > 0, (F.col(s) + F.col(f"{s}_kinds") * below[s]) / (F.col(f"{s}_n") + F.col(f"{s}_kinds")))
             .otherwise(below[s]).alias(f"{s}_below") for s in sides]
        lower = now.select(F.col("gram").alias("shorter"), "asked", *p)
        if k < ORDER:
            lower = lower.drop("asked")
    gain = F.log("accepted_below") - F.log("rejected_below")
    return lower.where("asked > 0").select(F.col("shorter").alias("gram"), "asked", gain.alias("gain"))


@dataclass
class Model:
    """Gains as a table; those asked for most also as sorted arrays; the threshold."""

    table: DataFrame
    grams: np.ndarray
    gain: np.ndarray
    least: int | None  # gains asked for less often are in the table alone; None: all are in the arrays
    threshold: float = 0.0

    def score(self, urls: DataFrame, name: str = "url_score") -> DataFrame:
        """urls with the log-likelihood difference per character (the end counts as one).

        A URL with rare grams takes their gains from a join; it has fewer than `least` rows, as
        its grams were counted over all rows, so no key is hot there.
        """
        grams, gain = self.grams, self.gain

        def each(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for urls in batches:
                known, sizes, rare = [], [], []
                for piece in _pieces(urls.where(urls.notna(), None).tolist()):
                    gram, owner = _grams(piece)
                    at = np.minimum(np.searchsorted(grams, gram), max(len(grams) - 1, 0))
                    found = grams[at] == gram if len(grams) else np.zeros(len(gram), dtype=bool)
                    weights = np.where(found, gain[at], 0.0) if len(grams) else np.zeros(len(gram))
                    known.append(np.bincount(owner, weights=weights, minlength=len(piece)))
                    sizes.append(np.bincount(owner, minlength=len(piece)))
                    cuts = np.searchsorted(owner[~found], np.arange(1, len(piece)))
                    rare += np.split(gram[~found], cuts)
                yield pd.DataFrame({
                    "known": np.concatenate(known) if known else np.zeros(0),
                    "size": np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64),
                    "rare": pd.Series(rare, dtype=object)})

        parts = F.pandas_udf(each, "known double, size long, rare array<long>")
        judged = urls.withColumn("__part", parts("url"))
        total = F.col("__part.known")
        if self.least is not None:
            key = F.struct(F.xxhash64("url"), F.xxhash64(F.lit("second"), "url"))
            judged = judged.withColumn("__key", key)
            rare = (
                judged.where(F.size("__part.rare") > 0).select("__key", "__part.rare").dropDuplicates(["__key"])
                .select("__key", F.explode("rare").alias("gram"))
                .join(self.table.where(F.col("asked") < self.least).select("gram", "gain"), "gram")
                .groupBy("__key").agg(F.sum("gain").alias("__rare"))
            )
            judged = judged.join(rare, "__key", "left")
            total = total + F.coalesce("__rare", F.lit(0.0))
        return judged.withColumn(name, total / F.col("__part.size")).select(*urls.columns, name)


def fit(labelled: DataFrame, asked: DataFrame, frequent: int = FREQUENT) -> Model:
    """Model from labelled (url, verdict allow or block) for the URLs of asked (url).

    All distinct labelled URLs are counted, but for the share kept apart. The threshold is the
    score that separates those best (mean of both classes' hit rates, from a histogram; of equals
    the one nearest to 0). Without both classes it is 0. The model can judge the rows of asked.
    """
    rows = labelled.select("url", "verdict").distinct().withColumn(
        "apart", unit_hash(F.lit("apart"), "url") < CALIBRATED)
    rows = stored(rows, "labelled-urls")
    apart = rows.where("apart")
    side = F.when(F.col("verdict") == "allow", "accepted").otherwise("rejected")
    counts = stored(gram_counts(
        rows.where("not apart").select("url", side.alias("side"))
        .union(asked.select("url", F.lit("asked"))).union(apart.select("url", F.lit("asked")))), "url-grams")
    table = stored(gains(counts), "url-gains")
    power = F.floor(F.log2("asked")).cast("int")
    at_least, least = 0, 0
    for power, n in sorted(((r.power, r.n) for r in table.groupBy(power.alias("power")).agg(
            F.count("*").alias("n")).collect()), reverse=True):  # at most 64 rows
        at_least += n
        if at_least > frequent:
            least = 1 << (power + 1)
            break
    most = table.where(F.col("asked") >= least).select("gram", "gain").toPandas().sort_values("gram")  # at most `frequent`
    model = Model(table, most["gram"].to_numpy(dtype=np.int64), most["gain"].to_numpy(dtype=np.float64), least or None)
    edge = F.floor(F.greatest(F.least(F.col("url_score"), F.lit(float(LIMIT))), F.lit(-float(LIMIT))) * BINS)
    bins = model.score(apart).groupBy(edge.alias("at"), (F.col("verdict") == "allow").alias("good")).count().toPandas()
    found = bins.pivot_table(index="at", columns="good", values="count", aggfunc="sum", fill_value=0).sort_index()
    if len(found.columns) == 2:
        bad, good = found[False].to_numpy(dtype=float), found[True].to_numpy(dtype=float)
        at = found.index.to_numpy(dtype=np.int64)
        low, high = np.append(at[0], at + 1), np.append(at, at[-1] + 1)  # a cut may lie anywhere between them
        value = np.append(0, np.cumsum(bad)) / bad.sum() + 1 - np.append(0, np.cumsum(good)) / good.sum()
        best = np.flatnonzero(value >= value.max() - 1e-12)
        cuts = (low[best] + high[best]) / 2 / BINS
        model.threshold = float(cuts[np.abs(cuts).argmin()])
    return model


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict (null where no rule fits)."""
    host, path = host_and_path(F.col("url"))
    named = pages.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "url_score")],
                         host.alias("host"), path.alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return named.withColumn("rule", rule).withColumn("verdict", verdict)


def judge(pages: DataFrame, rules=RULES, frequent: int = FREQUENT) -> DataFrame:
    """pages (url, ...) with host, path, rule, verdict (allow or block) and url_score.

    The rule's verdict if one fits, else allow where the score is at or above the threshold.
    A null or empty url has the score of its end mark alone. Every row is kept; repeated rows
    are judged alike, and hosts or URLs of any number of rows do no harm. Columns of these names
    are replaced.
    """
    known = ruled(pages, rules)
    model = fit(known.where("verdict is not null and url is not null"), known.select("url"), frequent)
    says = F.when(F.col("url_score") >= F.lit(model.threshold), "allow").otherwise("block")
    return model.score(known).withColumn("verdict", F.coalesce("verdict", says))
