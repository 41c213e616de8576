"""Lattice hashing against all pairs."""

import numpy as np
import pytest

from fieldtide.llm import vectors
from tests.llm.test_common import brute


def rows_of(d=32, seed=2):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(60):
        base = rng.standard_normal(d)
        out.append(base)
        for _ in range(rng.integers(0, 5)):
            out.append(base / np.linalg.norm(base) + rng.standard_normal(d) * rng.choice([0.01, 0.03, 0.055]))
    out += [out[0], out[0] * 3, out[1], out[5] * 1e-30]
    return [[float(v) for v in np.float32(x)] for x in out]


def brute_links(rows, cosine):
    x = np.array(rows)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -1)
    return s >= cosine


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)) * 2
    p = vectors.e8_decode(x)
    twice = 2 * p
    assert np.allclose(twice, np.round(twice)) and (np.round(p.sum(axis=1)).astype(int) % 2 == 0).all()
    assert all(len(set((np.abs(r) % 2).tolist())) == 1 for r in twice)
    near = ((x - p) ** 2).sum(axis=1)
    for step in vectors.e8_neighbours():
        assert (((x - p - step) ** 2).sum(axis=1) >= near - 1e-9).all()


@pytest.mark.parametrize("block", [7, 2000])
def test_groups_equal_all_pairs(spark, block):
    rows = rows_of()
    wrong = [None, [], [0.0] * 32, [1.0, None] + [0.0] * 30, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0, 2.0]]
    table = [(i, v, i % 3) for i, v in enumerate(rows + wrong)]
    got = vectors.embedding_groups(spark.createDataFrame(table, "vec_id long, embedding array<float>, n int"), block=block)
    got = {r.vec_id: r for r in got.collect()}
    links = brute_links(rows, 0.95)
    a, b = np.nonzero(links)
    root = brute(list(zip(a.tolist(), b.tolist())))
    assert len(got) == len(table)
    for i in range(len(rows)):
        assert got[i].n_links == links[i].sum() and got[i].component == root.get(i, i)
    for i in range(len(rows), len(table)):
        assert got[i].n_links == 0 and got[i].component == i


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    rows = [[float(v) for v in np.float32(base + rng.standard_normal(16) * 0.08)] for _ in range(300)]
    got = vectors.embedding_groups(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>"))
    want = brute_links(rows, 0.95).sum(axis=1)
    have = {r.vec_id: r.n_links for r in got.collect()}
    assert sum(have.values()) >= 0.99 * want.sum() and all(have[i] <= want[i] for i in have)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal(a.shape)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * side
    ca, cb = vectors.cells(a), vectors.cells(b)
    met = ((ca[:, :, :1] == cb).any(axis=2) | (cb[:, :, :1] == ca).any(axis=2)).any(axis=1)
    assert met.mean() > 0.985  # pairs of exactly 0.95; closer ones meet more often


def test_rows_without_id(spark):
    rows = [(None, [1.0, 2.0]), (3, [1.0, 2.0]), (None, [9.0, -1.0]), (None, None)]
    got = vectors.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component or 0) for r in got) == [(0, 0, 0), (0, 0, 0), (0, 1, 3), (3, 1, 3)]


def test_empty_table(spark):
    assert vectors.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
