"""Connected components, blocks and sorted batches."""

import random

import numpy as np
import pyarrow as pa

from fieldtide.llm import common


def brute(links):
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_components(spark):
    rng = random.Random(1)
    path = list(range(100, 160))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(7, 7), (5, 9), (9, 5), (5, 9)]
    links += [(1000, 1000 + i) for i in range(1, 80)]
    links += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    got = common.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.id: r.component for r in got} == brute(links)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_blocks_meet_once(spark):
    rows = [(1, i) for i in range(23)] + [(2, 50), (2, 51)]
    got = common.pair_blocks(spark.createDataFrame(rows, "bucket long, key long"), "bucket", "key", 5).collect()
    met = {}
    for r in got:
        for q in got:
            if (r.bucket, r.lo, r.hi) == (q.bucket, q.lo, q.hi) and r.key < q.key and (r.lo == r.hi or r.own != q.own):
                met[(r.key, q.key)] = met.get((r.key, q.key), 0) + 1
    want = {(a, b) for x, a in rows for y, b in rows if x == y and a < b}
    assert set(met) == want and set(met.values()) == {1}


def test_blocks_are_joined_without_hot_buckets_too(spark):
    """One row an entry leaves the join, and the plan is the same for every size."""
    for rows, limit in (([(1, i) for i in range(23)], 100), ([(0, i) for i in range(23)] + [(0, 90)], 24), ([(1, 1)], 100)):
        got = common.pair_blocks(spark.createDataFrame(rows, "bucket long, key long"), "bucket", "key", limit)
        found = got.collect()
        assert "LeftOuter" in got._jdf.queryExecution().executedPlan().toString()
        met = {(r.key, q.key) for r in found for q in found
               if (r.lo, r.hi) == (q.lo, q.hi) and r.key < q.key and (r.lo == r.hi or r.own != q.own)}
        assert len(met) == len(rows) * (len(rows) - 1) // 2


def test_batches_split_no_group():
    column = np.repeat(np.arange(40), np.arange(40) % 7 + 1)
    table = pa.table({"k": column, "v": np.arange(len(column))})
    parts = list(common.grouped_batches(table.to_batches(3), ("k",), 10))
    assert pa.concat_tables(parts).equals(table) or pa.concat_tables(parts).to_pydict() == table.to_pydict()
    ends = [set(p["k"].to_pylist()) for p in parts]
    assert sum(map(len, ends)) == len(set().union(*ends)) and len(parts) > 5


def test_word_slices():
    data = b"aa bbb\ncccc " * 50 + b"x" * 300 + b" y"
    parts = list(common.word_slices(data, 40))
    assert b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()
    assert list(common.word_slices(b"")) == [b""]
