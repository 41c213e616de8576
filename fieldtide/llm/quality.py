"""Quality classifier by co-training.

Two views of a document learn from the same labels: its text content, and its metadata (source,
language tag, declared length, line layout). Over some rounds each view labels, out of all
unlabelled documents, those it is surest of for the other one. Both are calibrated on labels kept
apart, and a calibrated combination of the two scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.llm.common import sample_up_to, stored, word_slices

LABELLED = 8_000  # labelled documents the fit looks at, at most (in expectation)
ROUNDS = 4
EXCHANGED = 200  # documents a view labels for the other in a round, at most
SALTS = 64  # parts in which the surest documents are found before they meet
SURE = 0.95
LOST = 0.002  # share of good calibration documents that the threshold may lose
WORD_SLOTS, SOURCE_SLOTS, LANG_SLOTS = 128, 64, 16
RESULT = "score double, text_score double, meta_score double, kept boolean"


def text_view(text: str) -> np.ndarray:
    """Bytes, word forms and repetition of the whole text."""
    hist = np.zeros(256)
    slots = np.zeros(WORD_SLOTS)
    n = chars = repeated = distinct = 0
    last = None
    for part in word_slices(text.encode("utf-8", "surrogatepass"), 1 << 20):
        hist += np.bincount(np.frombuffer(part, dtype=np.uint8), minlength=256)
        words = part.split()
        if not words:
            continue
        counts = Counter(words)
        hashed = np.fromiter(map(zlib.crc32, counts), dtype=np.uint32, count=len(counts)) % WORD_SLOTS
        slots += np.bincount(hashed, weights=np.fromiter(counts.values(), dtype=float), minlength=WORD_SLOTS)
        repeated += sum(map(eq, words, words[1:])) + (last == words[0])
        last = words[-1]
        n, distinct, chars = n + len(words), distinct + len(counts), chars + sum(map(len, counts))
    many = max(n, 1)
    shape = [np.log1p(n) / 10, distinct / many, repeated / many, chars / max(distinct, 1) / 10]
    return np.concatenate([np.sqrt(hist / max(hist.sum(), 1)), np.sqrt(slots / many), shape])


def meta_view(text: str, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(SOURCE_SLOTS + LANG_SLOTS + 4)
    out[zlib.crc32(str(source).encode("utf-8", "surrogatepass")) % SOURCE_SLOTS] = 1
    out[SOURCE_SLOTS + zlib.crc32(str(lang).encode("utf-8", "surrogatepass")) % LANG_SLOTS] = 1
    lines = text.count("\n") + 1
    length = max(int(n_chars), 0) if n_chars is not None and n_chars == n_chars else 0
    out[-4:] = [np.log1p(length) / 10, np.log1p(lines) / 5, np.log1p(length / lines) / 5, n_chars is None]
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(penalty),
                               x.T @ (y - p) - penalty * w)
        size = np.abs(step).max()
        w = w + step * min(1.0, 10 / max(size, 1e-12))
        if size < 1e-4:
            break
    return w


def _margin(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    """Weights of both views, of their calibration (slope, constant) and of the combination."""

    views: list[np.ndarray]
    calibration: list[np.ndarray]
    mix: np.ndarray
    threshold: float

    def scores(self, views: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        z = [c[0] * _margin(x, w) + c[1] for x, w, c in zip(views, self.views, self.calibration)]
        z = [np.clip(v, -30, 30) for v in z]
        return _sigmoid(np.clip(np.stack(z, axis=1) @ self.mix[:-1] + self.mix[-1], -30, 30)), [_sigmoid(v) for v in z]


Given = list[tuple[list[np.ndarray], np.ndarray]]  # for each view: both views of its surest rows, their marks


class ArrayPool:
    """Unlabelled rows in memory, as one array for each view."""

    def __init__(self, views: list[np.ndarray]):
        self.views, self.free = views, np.ones(len(views[0]), dtype=bool)

    def surest(self, weights: list[np.ndarray], goods: int, bads: int) -> Given:
        """Rows each view is surest of, at most so many good and bad ones; they are not free any more."""
        rows = []
        for view, w in zip(self.views, weights):
            p = _sigmoid(_margin(view, w))
            good, bad = np.flatnonzero(self.free & (p >= SURE)), np.flatnonzero(self.free & (p <= 1 - SURE))
            rows.append((good[np.argsort(-p[good], kind="stable")][:goods], bad[np.argsort(p[bad], kind="stable")][:bads]))
        for pair in rows:
            self.free[np.concatenate(pair)] = False
        return [([v[np.concatenate(pair)] for v in self.views], np.repeat([1.0, 0.0], [len(k) for k in pair]))
                for pair in rows]


class StoredPool:
    """All rows of a table (key, text, meta: packed views), judged on the executors in every round.

    Rows of one key are one document. Keys and probabilities alone are shuffled: the best of each
    of SALTS parts, then the best of those. At most 4 x `exchanged` rows a round reach the driver.
    """

    def __init__(self, rows: DataFrame):
        self.rows, self.used = stored(rows, "quality-pool"), []

    def surest(self, weights: list[np.ndarray], goods: int, bads: int) -> Given:
        def each(text: pd.Series, meta: pd.Series) -> pd.DataFrame:
            p = [_sigmoid(_margin(_unpacked(v, len(w) - 1), w)) for v, w in zip((text, meta), weights)]
            return pd.DataFrame({"p0": p[0], "p1": p[1]})

        judged = F.pandas_udf(each, "p0 double, p1 double")
        sure = [F.struct(F.lit(i).alias("view"), F.col(f"p.p{i}").alias("p")) for i in (0, 1)]
        found = (
            self.rows.where(~F.col("key").isin(self.used)) if self.used else self.rows
        ).select("key", judged("text", "meta").alias("p")).select("key", F.inline(F.array(*sure))).where(
            (F.col("p") >= SURE) | (F.col("p") <= 1 - SURE)
        ).groupBy("view", "key").agg(F.first("p").alias("p")).withColumn("good", F.col("p") >= SURE)
        order = F.abs(F.col("p") - 0.5).desc(), F.col("key")
        most = max(goods, bads)
        for by in (["view", "good", F.pmod("key", F.lit(SALTS))], ["view", "good"]):
            found = found.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("n") <= most)
        picks = found.where(F.col("n") <= F.when(F.col("good"), goods).otherwise(bads)).orderBy("view", F.desc("good"), "n").toPandas()
        keys = sorted({int(k) for k in picks["key"]})
        self.used += keys
        sizes = [len(w) - 1 for w in weights]
        if not keys:
            return [([np.zeros((0, n)) for n in sizes], np.zeros(0))] * 2
        rows = self.rows.where(F.col("key").isin(keys)).dropDuplicates(["key"]).toPandas().set_index("key")
        given = []
        for view in (0, 1):
            mine = picks[picks["view"] == view]
            at = rows.loc[mine["key"]]
            given.append(([_unpacked(at[k], n) for k, n in zip(("text", "meta"), sizes)], mine["good"].to_numpy(dtype=float)))
        return given


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray] | ArrayPool | StoredPool,
             rounds: int = ROUNDS, exchanged: int = EXCHANGED, lost: float = LOST) -> Model | None:
    """Model from the two views of labelled and unlabelled rows; None without both classes."""
    fold = np.arange(len(y)) % 4 == 3  # rows come in the order of a hash
    train, hold = ~fold, fold
    if len(set(y[train])) < 2 or len(set(y[hold])) < 2:
        return None
    sets = [(v[train], y[train]) for v in labelled]
    pool = ArrayPool(pool) if isinstance(pool, list) else pool
    weights = [logistic(*s) for s in sets]
    share = max(y[train].mean(), 1e-9)
    for _ in range(rounds):
        given = pool.surest(weights, int(np.ceil(exchanged * share)), int(np.ceil(exchanged * (1 - share))))
        for view in (0, 1):
            rows, marks = given[1 - view]
            sets[view] = (np.vstack([sets[view][0], rows[view]]), np.concatenate([sets[view][1], marks]))
        weights = [logistic(*s) for s in sets]
        if not any(len(marks) for _, marks in given):
            break
    margins = [_margin(v[hold], w) for v, w in zip(labelled, weights)]
    calibration = [logistic(m[:, None], y[hold], 0.1) for m in margins]
    z = np.stack([np.clip(c[0] * m + c[1], -30, 30) for m, c in zip(margins, calibration)], axis=1)
    mix = logistic(z, y[hold], 0.1)
    found = _sigmoid(np.clip(z @ mix[:-1] + mix[-1], -30, 30))
    threshold = min(0.5, float(np.quantile(found[y[hold] == 1], lost)))
    return Model(weights, calibration, mix, threshold)


def _views(text, source, lang, n_chars) -> list[np.ndarray]:
    texts = [t if t is not None else "" for t in text]
    return [np.stack([text_view(t) for t in texts]).astype(np.float64) if texts else np.zeros((0, 1)),
            np.stack([meta_view(*r) for r in zip(texts, source, lang, n_chars)]) if texts else np.zeros((0, 1))]


def _packed_views(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
    both = [v.astype(np.float32) for v in _views(text, source, lang, n_chars)]
    return pd.DataFrame({k: [r.tobytes() for r in v] for k, v in zip(("text", "meta"), both)})


def _unpacked(packed: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=np.float32).reshape(len(packed), size).astype(np.float64)


COLUMNS = ("text", "source", "lang", "n_chars")


def packed_views(docs: DataFrame, *more: str) -> DataFrame:
    """key (a hash of both views), text and meta (packed views) and the columns `more` of docs with text."""
    packed = F.pandas_udf(_packed_views, "text binary, meta binary")
    return (
        docs.where(F.trim("text") != "").select(*more, packed(*COLUMNS).alias("v"))
        .select(*more, F.xxhash64("v.text", "v.meta").alias("key"), "v.text", "v.meta")
    )


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, exchanged: int = EXCHANGED) -> Model | None:
    """Co-trained model from docs (doc_id, text, source, lang, n_chars) and labels (doc_id, quality).

    A bounded sample of labelled ids by hash, about `labelled`, reduced to feature vectors on the
    executors; rows of one id teach once, by the views with the smallest hash. The exchange looks
    at all other documents, those without an id too; documents with equal views count once. Null
    labels and blank texts teach nothing. Labels that contradict each other count by their mean,
    0.5 and more as good. None if a class is missing.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        (F.avg("quality") >= 0.5).cast("double").alias("__y"))
    known = F.broadcast(sample_up_to(known, labelled, "doc_id"))  # bounded by `labelled`
    rows = (
        packed_views(docs.join(known, "doc_id"), "doc_id", "__y")
        .groupBy("doc_id", "__y").agg(F.min(F.struct("key", "text", "meta")).alias("v"))
        .select(F.xxhash64("doc_id").alias("__h"), "__y", "v.text", "v.meta").toPandas()
        .sort_values("__h", kind="stable")
    )
    if rows["__y"].nunique() < 2:
        return None
    views = [np.array([np.frombuffer(b, dtype=np.float32) for b in rows[k]], dtype=np.float64) for k in ("text", "meta")]
    pool = StoredPool(packed_views(docs.join(known, "doc_id", "left_anti")))
    return co_train(views, rows["__y"].to_numpy(dtype=float), pool, exchanged=exchanged)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score, text_score, meta_score (0 to 1) and kept.

    Blank or null text: 0.0, not kept. Without a model (no labels): 0.5, kept. Null source, lang
    and n_chars are values of their own.
    """
    def each(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, source, lang, n_chars in batches:
            full = np.array([t is not None and bool(t.strip()) for t in text], dtype=bool)
            if model is None or not len(full):
                s, parts, limit = np.full(len(full), 0.5), [np.full(len(full), 0.5)] * 2, 0.5
            else:
                s, parts = model.scores(_views(text, source, lang, n_chars))
                limit = model.threshold
            yield pd.DataFrame({
                "score": np.where(full, s, 0.0), "text_score": np.where(full, parts[0], 0.0),
                "meta_score": np.where(full, parts[1], 0.0), "kept": full & (s >= limit)})

    judged = F.pandas_udf(each, RESULT)
    new = ("score", "text_score", "meta_score", "kept")
    return docs.withColumn("__judged", judged(*COLUMNS)).select(
        *[c for c in docs.columns if c not in new], *[f"__judged.{c}" for c in new])
