"""Near copies against brute-force Jaccard of five-word shingles."""

import itertools
import random

import numpy as np

import corpus_pipeline
from fieldtide.llm import neardup

SCHEMA = "doc_id long, text string"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    sets = {i: plain_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] == sets[b] or common >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def edited(rng, words, changes):
    copy = list(words)
    for at in rng.sample(range(len(copy)), changes):
        copy[at] = f"new{rng.random()}"
    return " ".join(copy)


def texts():
    rng = random.Random(8)
    out = [None, "", "One two", "one  TWO", "one three", "a b c d e f g h", "a b c d e f g h i"]
    for n in (40, 200, 900):
        for _ in range(12):
            base = [f"w{rng.randrange(5000)}" for _ in range(n)]
            out.append(" ".join(base))
            out.extend(edited(rng, base, k) for k in (n // 100 + 1, n // 60 + 1, n // 45, n // 30, n // 12))
    return out


def test_groups_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r.component for r in neardup.similar_groups(spark.createDataFrame(rows, SCHEMA), block=7).collect()}
    want = brute_groups(rows)
    assert got == want and len(set(want.values())) < len(rows) - 30


def test_stage_drops_pairs_beyond_three_bits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute_groups([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in want.items() if i == root)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (1, "A b c"), (None, "a b c"), (2, None), (4, " ")], SCHEMA)
    assert sorted(r.doc_id or 0 for r in neardup.drop_similar(docs).collect()) == [0, 1, 2]
    assert neardup.drop_similar(docs.limit(0)).count() == 0


def test_columns_with_clashing_names(spark):
    rows = [(i, t, "x", 1, i, b"y", 2, "z") for i, t in enumerate(texts()[:40])]
    docs = spark.createDataFrame(
        rows, "doc_id int, text string, digest string, a int, component long, shingles binary, __rep int, __text string")
    want = brute_groups([(r[0], r[1]) for r in rows])
    kept = neardup.drop_similar(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in want.items() if i == root)


def test_large_group_leaves_as_a_forest(spark, monkeypatch):
    """One text with 300 near copies: links, not pairs, and the hub's links are dealt out."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = [(0, " ".join(base))] + [(i, edited(rng, base, 2)) for i in range(1, 300)] + [(900, " ".join(base[:60]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    classes = neardup.sketches(docs)
    entries = classes.select(neardup.F.explode("cells").alias("cell"), "digest", "size", *neardup.WIDE).withColumn(
        "component", neardup.F.col("digest"))
    assert neardup.nearest_links(entries, 50).count() < 300 * neardup.BANDS
    monkeypatch.setattr(neardup.confirmed, "__defaults__", (7,))
    got = {r.doc_id: r.component for r in neardup.similar_groups(docs, 50).collect()}
    assert got == brute_groups(rows) and set(got.values()) == {0, 900}


def test_long_text_and_ties(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(90000)}" for _ in range(200_000)]
    rows = [(5, " ".join(base)), (4, edited(rng, base, 400)), (3, " ".join(base)), (8, "short one here to keep alone")]
    got = {r.doc_id: r.component for r in neardup.similar_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 8: 8}


def test_cells_meet_as_often_as_computed():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(400):  # similarity 0.6: 1 - (1 - 0.6^4)^20 = 0.938
        pool = rng.integers(0, 2**64, 1000, dtype=np.uint64)
        met += bool((neardup.anchor_cells(pool[:800]) == neardup.anchor_cells(pool[200:])).any())
    assert 0.89 < met / 400 < 0.98


def test_simhash_links_are_part_of_the_stage(spark):
    """Fingerprints within the radius are one group, whatever the similarity of the word sets."""
    from fieldtide.llm.simhash import fingerprint

    words = [f"w{i}" for i in range(400)]
    a = " ".join(words[:9] * 300)  # nine shingles in equal shares: no bit is near its half
    b = a + " " + " ".join(words[10:30])  # few of all shingles, most of the distinct ones
    assert bin((fingerprint(a) ^ fingerprint(b)) & (2**64 - 1)).count("1") <= 3
    docs = spark.createDataFrame([(7, a), (9, b), (11, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id for r in neardup.similar_groups(docs).where("doc_id = component").collect()} == {7, 9, 11}
    assert {r.doc_id for r in neardup.drop_similar(docs).collect()} == {7, 11}


def test_forest_of_bounded_pairs_is_as_short():
    rng = np.random.default_rng(5)
    n = 60
    x, y = (side.copy() for side in np.triu_indices(n, 1))
    far = rng.integers(0, 40, len(x))
    steps = [(x[i::50], y[i::50], far[i::50]) for i in range(50)]
    length = {frozenset(p): d for p, d in zip(zip(x.tolist(), y.tolist()), far.tolist())}
    order = np.argsort(far, kind="stable")
    want = [far[order[i]] for i in neardup.nearest_forest(n, x[order], y[order])]
    for held in (0, 7, 10**6):
        got = neardup.nearest_pairs(n, iter(steps), held).T.tolist()
        assert sorted(length[frozenset(p)] for p in got) == sorted(want)


def test_shingle_masks_equal_sets(monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) < 0.93], rng.integers(0, 2**64, 5, dtype=np.uint64)])) for _ in range(70)]
    sets.append(np.unique(rng.integers(0, 2**64, 9, dtype=np.uint64)))
    x, y = np.triu_indices(len(sets), 1)
    want = [neardup._similar(sets[i], sets[j]) for i, j in zip(x, y)]
    assert 100 < sum(want) < len(want) - 100
    assert neardup.similarity(sets)(x, y).tolist() == want
    monkeypatch.setattr(neardup, "MASKED_WORDS", 0)
    assert neardup.similarity(sets)(x, y).tolist() == want


def test_no_task_holds_the_pairs_of_a_block():
    """A block of near texts, none similar enough: a million candidates, all refuted."""
    import tracemalloc

    import pyarrow as pa

    n, rng = 1500, np.random.default_rng(7)
    base = rng.integers(0, 2**64, 70, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base, rng.integers(0, 2**64, 30, dtype=np.uint64)])) for _ in range(n)]
    numbers, zeros = pa.array(np.arange(n)), pa.array(np.zeros(n, dtype=np.int64))
    table = pa.table({"cell": zeros, "lo": zeros, "hi": zeros, "own": zeros, "size": pa.array([100] * n), "digest": numbers,
                      "component": numbers, **{w: zeros for w in neardup.WIDE}, "shingles": pa.array([s.tobytes() for s in sets])})
    assert sum(len(x) for x, _, _ in neardup._candidates(table, neardup._runs(table))) == n * (n - 1) // 2
    tracemalloc.start()
    assert not len(neardup.decided(table)[0])
    assert tracemalloc.get_traced_memory()[1] < 20e6  # the pairs alone, as two lists of numbers: 18 MB and more
    tracemalloc.stop()
