"""Co-training: held-out accuracy and odd inputs."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldtide.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = quality.fit(docs, labels.where(~apart), 2000, 1000)
    got = quality.score(docs, model).join(labels.where(apart), "doc_id").toPandas()
    assert (got.kept == (got.quality == 1)).mean() > 0.98
    assert got.kept[got.quality == 1].mean() > 0.99  # clean documents stay


def test_views_exchange_what_they_are_sure_of():
    right = []
    for seed in range(6):
        rng = np.random.default_rng(seed)
        y = (rng.random(3000) < 0.5).astype(float)
        views = [np.hstack([(y[:, None] - 0.5) * s + rng.standard_normal((3000, 1)), rng.standard_normal((3000, 60))])
                 for s in (3, 5)]
        few, pool, rest = slice(0, 60), slice(60, 2000), slice(2000, 3000)
        models = [quality.co_train([v[few] for v in views], y[few], [v[p] for v in views]) for p in (slice(0, 0), pool)]
        # the weaker view gains from the labels of the stronger one
        right.append([((views[0][rest] @ m.views[0][:-1] + m.views[0][-1] > 0) == y[rest]).mean() for m in models])
    alone, taught = np.mean(right, axis=0)
    assert taught > alone + 0.02


def test_nulls_blanks_and_clashing_columns(spark):
    rows = [(1, None, None, None, None, "x"), (2, " \n", "en", "s", 2, "x"), (3, "good text here", None, None, None, "x"),
            (3, "good text here", None, None, None, "x"), (4, "word " * 200_000, "en", "s", -5, "x")]
    docs = spark.createDataFrame(rows, SCHEMA + ", kept string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) is None
    got = quality.score(docs, None).collect()
    assert [(r.score, r.kept) for r in got] == [(0.0, False)] * 2 + [(0.5, True)] * 3
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 0), (None, 1), (5, None)], "doc_id long, quality int")
    many = spark.createDataFrame([(i, ("fine words " if i % 2 else "BAD!! ") * 20, "en", "s", 9) for i in range(60)], SCHEMA)
    model = quality.fit(many, labels)
    got = {r.doc_id: r.kept for r in quality.score(many, model).collect()}
    assert got[41] and not got[42]
    assert [r.kept for r in quality.score(docs, model).collect()][:2] == [False, False]
    assert quality.score(docs.limit(0), model).count() == 0


def test_text_view_of_slices(monkeypatch):
    text = "one two two three\n" * 3000
    whole = quality.text_view(text)
    parts = [p for p in quality.word_slices(text.encode(), 1000)]
    monkeypatch.setattr(quality, "word_slices", lambda data, size: iter(parts))
    cut = quality.text_view(text)
    assert np.allclose(whole[:256 + quality.WORD_SLOTS], cut[:256 + quality.WORD_SLOTS]) and np.isclose(whole[-2], cut[-2])


def test_pool_on_executors_gives_what_arrays_give(spark):
    rng = np.random.default_rng(5)
    views = [rng.standard_normal((900, k)).astype(np.float32) for k in (6, 4)]
    rows = [(i, views[0][i].tobytes(), views[1][i].tobytes()) for i in range(900)]
    pool = spark.createDataFrame(rows + rows[:50] * 3, "key long, text binary, meta binary").repartition(7)
    stored, arrays = quality.StoredPool(pool), quality.ArrayPool([v.astype(np.float64) for v in views])
    weights = [np.append(rng.standard_normal(k) * 3, 0.1) for k in (6, 4)]
    for goods, bads in ((20, 30), (5, 0), (400, 400), (400, 400)):
        for got, want in zip(stored.surest(weights, goods, bads), arrays.surest(weights, goods, bads)):
            assert (got[1] == want[1]).all()
            assert all((a == b).all() and a.shape == b.shape for a, b in zip(got[0], want[0]))
    assert len(got[1]) == 0  # the last round found nothing that was not given before
    empty = quality.StoredPool(pool.limit(0)).surest(weights, 3, 3)
    assert [(v[0].shape, v[1].shape, len(marks)) for v, marks in empty] == [((0, 6), (0, 4), 0)] * 2


def test_rows_of_one_id_teach_once_and_ids_may_be_null(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "co_train", lambda views, y, pool, **more: seen.append((len(y), pool.rows)))
    text = [("fine words " if i % 2 else "BAD!! ") * 20 for i in range(60)]
    rows = [(1, t + str(i), "en", "s", 9) for i, t in enumerate(text)] + [(i, t, "en", "s", 9) for i, t in enumerate(text)]
    rows += [(None, "no id " * (i % 3 + 1), None, None, None) for i in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    quality.fit(spark.createDataFrame(rows, SCHEMA), labels)
    (labelled, pool), = seen
    assert labelled == 40  # one row for each labelled id
    assert pool.count() == 20 + 30 and pool.select("key").distinct().count() == 2 + 3


def plain_logistic(rows, marks, ridge):
    """Ridge logistic regression by small gradient steps with momentum, until the slope is nothing."""
    x = np.hstack([np.asarray(rows), np.ones((len(rows), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w, v, k = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    step = 1 / (np.linalg.norm(x, 2) ** 2 / 4 + ridge)
    for _ in range(300_000):
        ahead = w + k / (k + 3) * v
        slope = x.T @ (1 / (1 + np.exp(-x @ ahead)) - marks) + penalty * ahead
        new = ahead - step * slope
        k = k + 1 if slope @ (new - w) <= 0 else 0  # uphill: start anew without momentum
        w, v = new, new - w
        if np.abs(slope).max() < 1e-8:
            break
    else:
        raise AssertionError("the plain form has not converged")
    return w


def test_co_training_equals_a_plain_form():
    rng = np.random.default_rng(11)
    y = (rng.random(700) < 0.6).astype(float)
    views = [np.hstack([(y[:, None] - 0.5) * s + rng.standard_normal((700, 1)), rng.standard_normal((700, 3))]) for s in (4, 6)]
    few, rest = slice(0, 100), slice(100, 700)
    model = quality.co_train([v[few] for v in views], y[few], [v[rest] for v in views], rounds=2, exchanged=30)
    train = [i for i in range(100) if i % 4 != 3]
    hold = [i for i in range(100) if i % 4 == 3]
    rows = [[v[i] for i in train] for v in views]
    marks = [[y[i] for i in train] for _ in views]
    share, free = np.mean(y[train]), set(range(100, 700))
    p = lambda w, row: 1 / (1 + np.exp(-(row @ w[:-1] + w[-1])))
    for _ in range(2):
        weights = [plain_logistic(r, np.array(m), 1.0) for r, m in zip(rows, marks)]
        picks = []
        for v, w in zip(views, weights):
            sure = sorted((-abs(p(w, v[i]) - 0.5), i) for i in free)
            good = [i for _, i in sure if p(w, v[i]) >= quality.SURE][:int(np.ceil(30 * share))]
            bad = [i for _, i in sure if p(w, v[i]) <= 1 - quality.SURE][:int(np.ceil(30 * (1 - share)))]
            picks.append([(i, 1.0) for i in good] + [(i, 0.0) for i in bad])
        for view in (0, 1):
            rows[view] += [views[view][i] for i, _ in picks[1 - view]]
            marks[view] += [mark for _, mark in picks[1 - view]]
        free -= {i for pair in picks for i, _ in pair}
    assert all(len(m) > 75 + 10 for m in marks)  # both views were taught
    weights = [plain_logistic(r, np.array(m), 1.0) for r, m in zip(rows, marks)]
    z = [[v[i] @ w[:-1] + w[-1] for i in range(700)] for v, w in zip(views, weights)]
    scaled = []
    for m in z:
        a, b = plain_logistic([[m[i]] for i in hold], y[hold], 0.1)
        scaled.append([a * k + b for k in m])
    mix = plain_logistic([[s[i] for s in scaled] for i in hold], y[hold], 0.1)
    want = [1 / (1 + np.exp(-(sum(s[i] * k for s, k in zip(scaled, mix)) + mix[-1]))) for i in range(700)]
    got, parts = model.scores(views)
    assert np.allclose(got, want, atol=1e-3)
    assert all(np.allclose(part, 1 / (1 + np.exp(-np.array(s))), atol=1e-3) for part, s in zip(parts, scaled))


def test_text_view_marks_bytes_and_words_that_occur():
    text = "Aa bb bb é\n\n2 bb bb  Aa"
    got = quality.text_view(text)
    data, words = text.encode(), text.encode().split()
    assert got[:256].sum() > 0 and all((got[b] > 0) == (b in data) for b in range(256))
    slots = {zlib.crc32(w) % quality.WORD_SLOTS for w in words}
    assert {i for i in range(quality.WORD_SLOTS) if got[256 + i] > 0} == slots
