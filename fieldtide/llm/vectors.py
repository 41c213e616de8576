"""Embedding near-duplicates by lattice hashing.

Vectors of length one are projected at random to twice eight numbers per table and decoded to the
nearest points of the E8 lattice. A vector enters its own cell and the neighbouring cells whose
decision borders are nearest; two vectors meet if the own cell of one is among those of the other.
Whoever meets is compared by cosine in double precision, so no link is wrong; the tables bound
the chance that one is missed (recall is measured in tests/llm).
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import components, forest, grouped_batches, pair_blocks, stored

COSINE = 0.95
TABLES = 8
PROBES = 2
SCALE = 1.3  # lattice units per unit of distance: vectors of cosine 0.95 are 0.41 apart
BLOCK = 2_000  # entries of a cell that are compared in one piece
DENSE = 64  # groups above it are compared by a matrix product
CHUNK = 100_000  # pairs in memory at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


def e8_decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice point: the nearer of the nearest points of D8 and of D8 shifted by 1/2."""
    def d8(y):
        near = np.round(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    a, b = d8(x), d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def e8_neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = [np.eye(8)[i] * s + np.eye(8)[j] * t for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(out)


def _mixed(points: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit key of lattice points (rows; doubled they are whole)."""
    whole = (2 * points).astype(np.int64).view(np.uint64)
    h = np.full(len(points), seed, dtype=np.uint64)
    for k in range(whole.shape[1]):
        h = (h ^ whole[:, k]) * _MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 1) -> np.ndarray:
    """Keys [vector, table, 1 + probes]: the own cell first, then the neighbours by distance."""
    n, d = unit.shape
    steps = e8_neighbours()
    out = np.zeros((n, tables, 1 + probes), dtype=np.int64)
    for table in range(tables):
        rng = np.random.default_rng([seed, d, table])
        y = unit @ (rng.standard_normal((d, 16)) * (scale / np.sqrt(8))) + rng.random(16) * 2
        own, options = [], []
        for half in (0, 1):
            part = y[:, 8 * half:8 * half + 8]
            point = e8_decode(part)
            cost = 2 - 2 * ((part - point) @ steps.T)  # how much farther each neighbour is
            best = np.argpartition(cost, probes, axis=1)[:, :probes + 1]
            order = np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable")
            best = np.take_along_axis(best, order, 1)
            own.append(point)
            options.append((steps[best], np.take_along_axis(cost, best, 1)))
        moves, costs = [], []  # of both halves; no move costs nothing
        for i in range(probes + 1):
            for j in range(probes + 1):
                if i or j:
                    a = options[0][0][:, i - 1] if i else np.zeros((n, 8))
                    b = options[1][0][:, j - 1] if j else np.zeros((n, 8))
                    moves.append(np.hstack([a, b]))
                    costs.append((options[0][1][:, i - 1] if i else 0) + (options[1][1][:, j - 1] if j else 0))
        point = np.hstack(own)
        key_seed = (seed * 1_000_003 + d) * 1_000 + table
        out[:, table, 0] = _mixed(point, key_seed)
        if probes:
            pick = np.argsort(np.stack(costs, axis=1), axis=1, kind="stable")[:, :probes]
            moves = np.stack(moves, axis=1)
            for k in range(probes):
                out[:, table, 1 + k] = _mixed(point + moves[np.arange(n), pick[:, k]], key_seed)
    return out


def usable(vector: Column) -> Column:
    """Not null, not empty, all numbers finite, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a list column end to end, and the length of each list."""
    import pyarrow.compute as pc

    if hasattr(column, "combine_chunks"):
        column = column.combine_chunks()
    if hasattr(column, "chunks"):
        import pyarrow as pa

        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64), lengths


def _by_length(column):
    """(positions, unit vectors) for each length of vector."""
    flat, lengths = _matrix(column)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, dtype=np.int64)
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = flat[starts[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def _meetings(group: np.ndarray, own: np.ndarray, cross: np.ndarray, first: np.ndarray, x: np.ndarray, cosine: float):
    """Pairs of positions in the same group, one of them in its own cell, with enough cosine."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(group)]]))
    small = np.repeat(sizes <= DENSE, sizes)
    at, k = np.flatnonzero(small), 0
    while len(at):
        k += 1
        at = at[at + k < len(group)]
        at = at[group[at] == group[at + k]]
        a = at[(first[at] | first[at + k]) & (~cross[at] | (own[at] != own[at + k]))]
        for i in range(0, len(a), CHUNK):
            some = a[i:i + CHUNK]
            some = some[np.einsum("ij,ij->i", x[some], x[some + k]) >= cosine]
            if len(some):
                yield some, some + k
    for start, size in zip(starts[sizes > DENSE], sizes[sizes > DENSE]):
        rows = np.arange(start, start + size)
        for i in range(0, size, 512):
            part = rows[i:i + 512]
            a, b = np.nonzero(x[part] @ x[start:start + size].T >= cosine)
            a, b = part[a], start + b
            keep = (a < b) & (first[a] | first[b]) & (~cross[a] | (own[a] != own[b]))
            yield a[keep], b[keep]


def _first_meeting(a: np.ndarray, b: np.ndarray, cell: np.ndarray, all_cells: np.ndarray) -> np.ndarray:
    """Which pairs meet here for the first time, in the order of tables and keys."""
    ca, cb = all_cells[a], all_cells[b]
    by_a = (ca[:, :, :1] == cb).any(axis=2)
    by_b = (cb[:, :, :1] == ca).any(axis=2)
    table = (by_a | by_b).argmax(axis=1)
    row = np.arange(len(a))
    none = np.iinfo(np.int64).max
    key = np.minimum(np.where(by_a[row, table], ca[row, table, 0], none), np.where(by_b[row, table], cb[row, table, 0], none))
    return key == cell


def close_pairs(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """classes (rep, embedding, n), one row per vector -> (rep, links, root) in parts.

    links: how many of the n of other vectors are linked, over the pairs counted in this part;
    each pair is counted in one part. root: the smallest rep linked to it there. Pairs are not
    listed, so a group of near copies gives rows in proportion to its size.
    """
    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            for rows, unit in _by_length(batch.column(1)):
                for i in range(0, len(rows), 4_000):
                    keys = cells(unit[i:i + 4_000])
                    times = pa.array(np.repeat(rows[i:i + 4_000], keys.shape[1] * keys.shape[2]))
                    own = np.zeros(keys.shape, dtype=bool)
                    own[:, :, 0] = True
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.ravel()), pa.array(own.ravel()), *(batch.column(c).take(times) for c in range(3))],
                        ["cell", "first", "rep", "embedding", "n"])

    def verify(batches):
        import pyarrow as pa

        for table in grouped_batches(batches, ("cell", "lo", "hi"), 50_000):
            cell, lo, hi, own, rep, n = (table[c].to_numpy() for c in ("cell", "lo", "hi", "own", "rep", "n"))
            first = table["first"].to_numpy()
            for rows, x in _by_length(table["embedding"]):
                c, r, m = cell[rows], rep[rows], n[rows]
                new = np.zeros(len(rows), dtype=np.int64)
                new[1:] = (c[1:] != c[:-1]) | (lo[rows][1:] != lo[rows][:-1]) | (hi[rows][1:] != hi[rows][:-1])
                links = np.zeros(len(rows), dtype=np.int64)
                left, right = [], []
                all_cells = None
                for a, b in _meetings(np.cumsum(new), own[rows], lo[rows] != hi[rows], first[rows], x, cosine):
                    other = r[a] != r[b]
                    a, b = a[other], b[other]
                    if not len(a):
                        continue
                    if all_cells is None:
                        nodes, where = np.unique(r, return_index=True)
                        number = np.searchsorted(nodes, r)
                        all_cells = {}
                    used = np.unique(number[np.concatenate([a, b])])
                    todo = [u for u in used.tolist() if u not in all_cells]
                    if todo:
                        all_cells.update(zip(todo, cells(x[where[todo]])))
                    table_of = np.stack([all_cells[u] for u in used.tolist()])
                    for i in range(0, len(a), CHUNK):
                        p, q = a[i:i + CHUNK], b[i:i + CHUNK]
                        once = _first_meeting(
                            np.searchsorted(used, number[p]), np.searchsorted(used, number[q]), c[p], table_of)
                        p, q = p[once], q[once]
                        links += np.bincount(p, weights=m[q], minlength=len(rows)).astype(np.int64)
                        links += np.bincount(q, weights=m[p], minlength=len(rows)).astype(np.int64)
                        left.append(p)
                        right.append(q)
                if left:
                    p, q = number[np.concatenate(left)], number[np.concatenate(right)]
                    root = nodes[forest(len(nodes), p, q)]
                    total = np.bincount(number, weights=links, minlength=len(nodes)).astype(np.int64)
                    tied = np.flatnonzero((total > 0) | (root != nodes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(nodes[tied]), pa.array(total[tied]), pa.array(root[tied])], ["rep", "links", "root"])

    vector = dict(classes.dtypes)["embedding"]
    entries = classes.select("rep", "embedding", "n").mapInArrow(
        spread, f"cell long, first boolean, rep long, embedding {vector}, n long")
    return (
        pair_blocks(entries, "cell", "rep", block)
        .repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
        .select("cell", "lo", "hi", "own", "first", "rep", "embedding", "n")
        .mapInArrow(verify, "rep long, links long, root long")
    )


def embedding_groups(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component) for every row of vectors (vec_id, embedding).

    n_links: other rows with a cosine of at least `cosine`; component: the smallest vec_id that
    links lead to. Equal vectors are one class, compared once. Null, empty, zero or non-finite
    vectors, and vectors of different length, link with nothing. Rows without vec_id only count as
    copies of their equals. Further columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", usable(F.col("embedding")).alias("fine"))
    classes = stored(
        rows.where("fine").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    parts = stored(close_pairs(classes.where("rep is not null"), cosine, block), "vector-links")
    groups = components(parts.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    named = stored(
        classes.join(links, "rep", "left")
        .join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
        .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component")), "vector-groups")
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    return rows.where("fine").join(named, "embedding").select("vec_id", "n_links", "component").union(alone)
