"""SimHash groups against all pairs."""

import random

import numpy as np
import pytest
import xxhash

from fieldtide.llm import simhash

SCHEMA = "doc_id long, text string"


def brute_mark(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, radius):
    """marks: {id: fingerprint}."""
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(marks)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", " \t\n", "One", "one", "A b", "a  B\x0b", "é\u00a0x", "x " * 30000]
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 40, 400]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def test_groups_equal_all_pairs(spark):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in simhash.simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    marks = {i: brute_mark(t) for i, t in rows}
    assert {i: r.fingerprint % 2**64 for i, r in got.items()} == marks
    assert {i: r.component for i, r in got.items()} == brute_groups(marks, 3)


@pytest.mark.parametrize("block", [4, 1000])
def test_hot_cells_and_chains(spark, block):
    rng = random.Random(3)
    marks, at = {}, 0
    for _ in range(6):  # groups of near fingerprints, chains, and loners
        mark = rng.getrandbits(64)
        for _ in range(rng.choice([3, 40])):
            for bit in rng.sample(range(64), rng.choice([1, 2, 3])):
                mark ^= 1 << bit
            if mark not in marks.values():
                marks[at] = mark
                at += 1
    rows = [(m - 2**64 if m >= 2**63 else m, i) for i, m in marks.items()]
    links = simhash.close_links(spark.createDataFrame(rows, "fingerprint long, rep long"), 3, block).collect()
    root = simhash.forest(at, np.array([r.a for r in links]), np.array([r.b for r in links]))
    assert dict(enumerate(root.tolist())) == brute_groups(marks, 3)
    assert all((marks[r.a] is not None) and r.a < r.b for r in links)


def test_rows_repeat_extra_columns_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_groups(empty).count() == 0
    assert simhash.drop_near_copies(empty).count() == 0
    docs = spark.createDataFrame(
        [(3, "a b c", 1, "x"), (3, "a b c", 1, "x"), (1, "a b c", 2, "y"), (2, None, 3, "z")],
        "doc_id long, text string, component long, fingerprint string")
    assert simhash.simhash_groups(docs).count() == 4
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    twice = spark.createDataFrame([(3, "a b c"), (3, "a b c")], SCHEMA)
    assert simhash.drop_near_copies(twice).count() == 1


def test_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "q"), (None, None), (5, "a b c")], SCHEMA)
    got = sorted(((r.doc_id or 0), r.component or 0) for r in simhash.simhash_groups(docs).collect())
    assert got == [(0, 0), (0, 0), (0, 4), (4, 4), (5, 4)]
    assert sorted(r.doc_id or 0 for r in simhash.drop_near_copies(docs).collect()) == [0, 0, 0, 4]


def test_parts_of_a_long_text(monkeypatch):
    text = " ".join(f"w{i % 17}" for i in range(1000))
    want = simhash.fingerprint(text)
    for part in (1, 7, 998, 999):
        monkeypatch.setattr(simhash, "PART", part)
        assert simhash.fingerprint(text) == want and want % 2**64 == brute_mark(text)
