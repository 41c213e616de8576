"""Decontamination against every window of every document."""

import random
import re
from collections import Counter

import pytest

from fieldtide.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def grams(words):
    return [tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def brute(docs, items, similarity=0.8):
    out = {}
    for d, text in docs:
        own = grams(re.findall(r"\w+", (text or "").lower()))
        for i, item in items:
            want = Counter(grams(re.findall(r"\w+", (item or "").lower())))
            k = want.total()
            if not k or not own:
                continue
            w = min(k, len(own))
            best = (0.0, 0)
            for s in range(len(own) - w + 1):
                common = (Counter(own[s:s + w]) & want).total()
                best = max(best, (common / (w + k - common), -s))
            if best[0] >= similarity:
                out[(d, i)] = (round(best[0], 9), -best[1])
    return out


def sample():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 30, 60])))) for i in range(25)]
    items += [(30, None), (31, "..."), (32, items[6][1]), (33, "a a a a a a a a a a a a"), (34, items[8][1] + " " + items[9][1])]
    docs = [(0, None), (1, ""), (2, " . "), (3, "a " * 5000), (4, items[4][1])]
    for d in range(5, 60):
        text = [rng.choice(words) for _ in range(rng.choice([2, 40, 300]))]
        for _ in range(rng.choice([0, 1, 2])):
            planted = (rng.choice(items)[1] or "").upper().split()
            if planted and rng.random() < 0.5:
                planted[rng.randrange(len(planted))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = [w + rng.choice(["", ",", "\n"]) for w in planted]
        docs.append((d, " ".join(text)))
    return docs, items


@pytest.mark.parametrize("chars", [10**6, 300])
def test_leaks_equal_all_windows(spark, monkeypatch, chars):
    docs, items = sample()
    monkeypatch.setattr(decontam, "BLOCK_CHARS", chars)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (chars,))
    got = decontam.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in got} == brute(docs, items)
    kept = decontam.drop_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {r.doc_id for r in kept} == {d for d, _ in docs} - {d for d, _ in brute(docs, items)}


def test_repeats_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 9), (1, "one two three four five six", 9)], DOCS + ", item_id int")
    items = spark.createDataFrame([(7, "One two, three four five six")] * 2, ITEMS)
    assert [tuple(r)[:2] for r in decontam.find_leaks(docs, items).collect()] == [(1, 7)]
    assert decontam.drop_leaks(docs, items).columns == docs.columns
    unnamed = spark.createDataFrame([(None, "one two three four five six"), (None, "x"), (2, "y")], ITEMS)
    assert [tuple(r)[:2] for r in decontam.find_leaks(docs, unnamed).collect()] == [(1, None)]
    none = spark.createDataFrame([], ITEMS)
    assert decontam.find_leaks(docs, none).count() == 0 and decontam.drop_leaks(docs, none).count() == 2
    assert decontam.find_leaks(docs.limit(0), items).count() == 0


def test_index_gives_all_marks_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(5)
    marks = rng.integers(0, 2**64, 150, dtype=np.uint64)
    near = marks[rng.integers(0, 150, 400)] ^ np.bitwise_or.reduce(
        np.uint64(1) << rng.integers(0, 64, (400, 22)).astype(np.uint64), axis=1)
    own = np.arange(3, 143)
    got = set(zip(*(x.tolist() for x in decontam.Marks(own, marks, 20).within(near))))
    assert got == {(i, int(k)) for i, m in enumerate(near) for k in own if int(m ^ marks[k]).bit_count() <= 20}
    assert len(got) > 100


def test_blocks_of_items_are_stored_between(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(
        ["one two three four five six seven", "a b c d e f g h", "x one two three four five six seven y " * 3, None])],
        "doc_id long, text string")
    items = spark.createDataFrame(
        [(1, "one two three four five six seven"), (2, "a b c d e f g h"), (3, "a b")], "item_id long, text string")
    whole = sorted(map(tuple, decontam.find_leaks(docs, items).collect()))
    kept = sorted(map(tuple, decontam.drop_leaks(docs, items).collect()), key=str)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (12,))
    assert sorted(map(tuple, decontam.find_leaks(docs, items).collect())) == whole and len(whole) == 3
    assert sorted(map(tuple, decontam.drop_leaks(docs, items).collect()), key=str) == kept and len(kept) == 1
