"""Near copies by five-word shingles: wide SimHash fingerprints that meet in anchor cells.

Copies are texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8. At
that similarity SimHash fingerprints differ in 15 % of their bits, and within so wide a radius
segment counts tell hardly any two texts apart (figures in the README). So fingerprints meet in
cells of smallest shingle hashes instead (BANDS cells of ROWS hashes: two texts of similarity s
share one with probability 1 - (1 - s^ROWS)^BANDS, 0.99997 at 0.8), are compared there on 256
bits, and shingles decide.

No task writes the pairs of a group. First every cell gives a spanning forest of its nearest
fingerprints, whose links are decided by the shingles. What could still join two groups then is
decided in the cells themselves: only texts of such cells send their shingles there, and again
only a forest of the links found leaves a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import components, forest, grouped_batches, pair_blocks, stored
from fieldtide.llm.simhash import BITS, BLOCK, PART, _by_doc, simhash_groups

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
RADIUS = 62  # of 256 bits; a pair of similarity 0.8 differs in 38.8, standard deviation 5.7
SPREAD = 500  # links of a text that are decided in one place
HELD = 500_000  # pairs of a table that wait for their forest
FEW = 50  # rows of a cell block whose shingle sets are compared one by one
MASKED_WORDS = 1 << 22  # of 64 bits: the masks of a cell block
CACHED_WORDS = 100_000
WIDE = ["w0", "w1", "w2", "w3"]
_MIX = np.uint64(0x9E3779B97F4A7C15)
_DRAWS = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
_FLIP, _ODD = _DRAWS[0], _DRAWS[1] | np.uint64(1)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the shingles. A text of fewer words is one shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=n)
    size = min(SHINGLE, n)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out = out * _MIX + h[k: n - size + 1 + k]
    return np.unique(_mixed(out))


def digest(own: np.ndarray) -> int:
    """64 bits that tell sets apart; zero for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def wide_mark(own: np.ndarray) -> np.ndarray:
    """256-bit SimHash of a set."""
    out = np.zeros(len(WIDE), dtype=np.int64)
    for k in range(len(WIDE)):
        seen = np.zeros(2048, dtype=np.int64)
        for at in range(0, len(own), PART):
            data = _mixed(own[at:at + PART] + np.uint64(k + 1)).view(np.uint8).reshape(-1, 8)
            seen += np.bincount((data + np.arange(0, 2048, 256)).ravel(), minlength=2048)
        out[k] = np.packbits((seen.reshape(8, 256) @ BITS).ravel() * 2 > len(own)).view(np.int64)[0]
    return out


def anchor_cells(own: np.ndarray) -> np.ndarray:
    """The cell of a set in each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, ((own[None, at:at + 2048] ^ _FLIP) * _ODD).min(axis=1))
    cell = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        cell = _mixed(cell * _MIX + column)
    return cell.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, size, w0 .. w3, cells) of every document; no cells without words."""
    def each(batches):
        import pyarrow as pa

        words = _Words()
        for batch in batches:
            sets = [shingle_set(t.as_py(), words) for t in batch.column(1)]
            wide = np.array([wide_mark(s) for s in sets], dtype=np.int64).reshape(-1, len(WIDE))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([digest(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()), *[pa.array(w) for w in wide.T.copy()],
                 pa.array([anchor_cells(s) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                ["doc_id", "digest", "size", *WIDE, "cells"])

    longs = ", ".join(f"{w} long" for w in WIDE)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        each, f"doc_id long, digest long, size long, {longs}, cells array<long>")


def _runs(table) -> np.ndarray:
    """Number of the cell block of each row of a sorted table."""
    cell, lo, hi = (table[c].to_numpy() for c in ("cell", "lo", "hi"))
    new = np.ones(len(cell), dtype=bool)
    new[1:] = (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return np.cumsum(new) - 1


def _candidates(table, run: np.ndarray):
    """Positions and bit distance of pairs of one cell block whose groups differ, sizes fit and
    fingerprints are near. They come by distance of their rows, at most one pair a row at a time,
    so no task holds the pairs of a block."""
    lo, hi, own, size, group = (table[c].to_numpy() for c in ("lo", "hi", "own", "size", "component"))
    wide = np.stack([table[w].to_numpy().view(np.uint64) for w in WIDE], axis=1)
    at, k = np.arange(len(run)), 0
    while len(at):
        k += 1
        at = at[at + k < len(run)]
        at = at[run[at] == run[at + k]]
        near = at[((lo[at] == hi[at]) | (own[at] != own[at + k])) & (group[at] != group[at + k])]
        small, large = np.minimum(size[near], size[near + k]), np.maximum(size[near], size[near + k])
        near = near[small >= SIMILARITY * large - 1e-9]
        bits = np.bitwise_count(wide[near] ^ wide[near + k]).sum(axis=1).astype(np.int64)
        near, bits = near[bits <= RADIUS], bits[bits <= RADIUS]
        if len(near):
            yield near, near + k, bits


def nearest_forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs x-y of n nodes, the nearest first, make a minimum spanning forest."""
    label, kept = np.arange(n), []
    nth = np.arange(len(x))
    while len(nth):
        ends = np.concatenate([label[x[nth]], label[y[nth]]])
        least = np.full(n, len(x))
        np.minimum.at(least, ends, np.concatenate([nth, nth]))
        chosen = np.unique(least[least < len(x)])
        kept.append(chosen)
        label = forest(n, label[x[chosen]], label[y[chosen]])[label]
        nth = nth[label[x[nth]] != label[y[nth]]]
    return np.concatenate(kept) if kept else nth


def nearest_pairs(n: int, steps, held: int = HELD) -> np.ndarray:
    """The pairs (2 rows) of a minimum spanning forest of n nodes under the pairs x-y of all steps.

    steps: (x, y, distance) in any order. At most `held` pairs beside a forest and one step are kept.
    """
    def least(parts):
        found = np.concatenate(parts, axis=1)
        found = found[:, np.argsort(found[2], kind="stable")]
        return found[:, nearest_forest(n, found[0], found[1])]

    parts = [np.zeros((3, 0), dtype=np.int64)]
    for step in steps:
        parts.append(np.stack(step))
        if sum(p.shape[1] for p in parts[1:]) > held:
            parts = [least(parts)]
    return least(parts)[:2]


def _met(entries: DataFrame, each, result: str, block: int | None) -> DataFrame:
    """entries dealt to their cells, and `each` over them; with `block` the cells are cut."""
    cut = entries if block is None else pair_blocks(entries, "cell", "digest", block)
    return cut.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(each, result)


def nearest_links(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b), a < b, that join all candidates of a cell by their nearest fingerprints."""
    def each(batches):
        import pyarrow as pa

        for table in grouped_batches(batches, ("cell", "lo", "hi")):
            nodes, where = np.unique(table["digest"].to_numpy(), return_inverse=True)
            steps = ((where[x], where[y], bits) for x, y, bits in _candidates(table, _runs(table)))
            a, b = nodes[nearest_pairs(len(nodes), steps)]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return _met(entries, each, "a long, b long", block).distinct()


def shingle_sets(docs: DataFrame, classes: DataFrame, ends: DataFrame) -> DataFrame:
    """(digest, shingles) of the classes named in `ends`, from the text of their first document."""
    def each(batches):
        import pyarrow as pa

        words, seen = _Words(), None
        for batch in batches:
            digests, sets = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = shingle_set(t.as_py(), words) if d != seen else None
                if own is not None and digest(own) == d:  # rows of one doc_id may have other texts
                    seen = d
                    digests.append(d)
                    sets.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.int64()), pa.array(sets, pa.binary())], ["digest", "shingles"])

    wanted = classes.join(ends, "digest", "left_semi").select("digest", F.col("rep").alias("__rep"))
    texts = docs.select(F.col("doc_id").cast("long").alias("__rep"), F.col("text").alias("__text"))
    found = texts.join(wanted, "__rep").select("digest", F.col("__text").alias("text"))
    return found.mapInArrow(each, "digest long, shingles binary").dropDuplicates(["digest"])


def _similar(one: np.ndarray, other: np.ndarray) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return common >= SIMILARITY * (len(one) + len(other) - common) - 1e-9


def confirmed(pairs: DataFrame, ends: DataFrame, sets: DataFrame, spread: int = SPREAD) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least SIMILARITY.

    ends: (digest, count) of the links of each text. A text of more than `spread` links stands in
    as many places as these need, and its links are dealt over them.
    """
    def each(batches):
        import pyarrow as pa

        for batch in batches:
            keep = [_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    hot = ends.where(F.col("count") > spread).select("digest", F.ceil(F.col("count") / spread).cast("int").alias("places"))
    one = F.lit(1)
    dealt = pairs
    for end, other in (("a", "b"), ("b", "a")):
        dealt = dealt.join(hot.select(F.col("digest").alias(end), "places"), end, "left").withColumn(
            f"at_{end}", F.pmod(F.xxhash64(other), F.coalesce("places", one)).cast("int")).drop("places")
    placed = sets.join(hot, "digest", "left").select(
        "digest", "shingles", F.explode(F.sequence(F.lit(0), F.coalesce("places", one) - 1)).alias("at"))
    for end, name in (("a", "one"), ("b", "other")):
        dealt = dealt.join(placed.select(F.col("digest").alias(end), F.col("at").alias(f"at_{end}"),
                                         F.col("shingles").alias(name)), [end, f"at_{end}"])
    return dealt.select("a", "b", "one", "other").mapInArrow(each, "a long, b long")


def open_entries(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Entries with a candidate of another component in their cell block, once for each block."""
    names = ["cell", "digest", "size", *WIDE, "component", "own", "lo", "hi"]

    def each(batches):
        for table in grouped_batches(batches, ("cell", "lo", "hi")):
            some = np.zeros(table.num_rows, dtype=bool)
            for x, y, _ in _candidates(table, _runs(table)):
                some[x] = some[y] = True
            yield from table.select(names).take(np.flatnonzero(some)).to_batches()

    wide = ", ".join(f"{w} long" for w in WIDE)
    return _met(entries, each, f"cell long, digest long, size long, {wide}, component long, own int, lo int, hi int", block)


def similarity(sets: list[np.ndarray]):
    """Function of positions x and y: which of the pairs have a similarity of at least SIMILARITY.

    Shingles of one set alone are common to no pair; the others are bits, if those fit in memory.
    """
    sizes = np.array([len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[code]
    words = int(place.max(initial=0)) // 64 + 1
    if len(sets) * words > MASKED_WORDS:
        return lambda x, y: np.array([_similar(sets[i], sets[j]) for i, j in zip(x, y)], dtype=bool)
    owner, place = np.repeat(np.arange(len(sets)), sizes)[place >= 0], place[place >= 0]
    mask = np.zeros((len(sets), words), dtype=np.uint64)
    np.bitwise_or.at(mask, (owner, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))

    def judged(x, y):
        common = np.bitwise_count(mask[x] & mask[y]).sum(axis=1, dtype=np.int64)
        return common >= SIMILARITY * (sizes[x] + sizes[y] - common) - 1e-9

    return judged


def decided(table) -> tuple[np.ndarray, np.ndarray]:
    """Links between the components of a sorted table with shingles: a forest, and no pair is held."""
    nodes, where = np.unique(table["component"].to_numpy(), return_inverse=True)
    own = [np.frombuffer(s.as_py(), np.uint64) for s in table["shingles"]]
    run, label = _runs(table), np.arange(len(nodes))
    first = np.flatnonzero(np.diff(run, prepend=-1))
    rows = np.diff(np.append(first, len(run)))
    judges = {}
    for x, y, _ in _candidates(table, run):
        apart = label[where[x]] != label[where[y]]  # not what earlier pairs have joined
        x, y = x[apart], y[apart]
        like = np.zeros(len(x), dtype=bool)
        large = rows[run[x]] > FEW
        like[~large] = [_similar(own[i], own[j]) for i, j in zip(x[~large], y[~large])]
        for r in np.unique(run[x[large]]):
            if r not in judges:
                judges[r] = similarity(own[first[r]:first[r] + rows[r]])
            mine = large & (run[x] == r)
            like[mine] = judges[r](x[mine] - first[r], y[mine] - first[r])
        label = forest(len(nodes), label[where[x[like]]], label[where[y[like]]])[label]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[tied]], nodes[tied]


def settled(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between components, decided by the shingles in each cell block."""
    def each(batches):
        import pyarrow as pa

        for table in grouped_batches(batches, ("cell", "lo", "hi"), rows=2000):
            yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()) for ends in decided(table)], ["a", "b"])

    return _met(entries.join(sets, "digest"), each, "a long, b long", None)


def similar_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, component): documents joined by pairs of similarity SIMILARITY and more.

    component is the smallest doc_id of the group. Equal shingle sets are one class; texts without
    words are one. Repeated rows of a doc_id are rows of their own here; rows of one doc_id with
    other texts are in the group of each. Rows without doc_id are not looked at, nor are further
    columns, whatever their names. A text of any length is one set of shingle hashes in memory.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    marked = stored(sketches(docs), "similar-sketches")
    rest = [F.first(c).alias(c) for c in ("size", *WIDE, "cells")]
    classes = stored(marked.groupBy("digest").agg(F.min("doc_id").alias("rep"), *rest), "similar-classes")
    entries = classes.where("size > 0").select(F.explode("cells").alias("cell"), "digest", "size", *WIDE)
    first = stored(nearest_links(entries.withColumn("component", F.col("digest")), block), "similar-first")
    ends = stored(first.select(F.explode(F.array("a", "b")).alias("digest")).groupBy("digest").count(), "similar-ends")
    sets = stored(shingle_sets(docs, classes, ends), "similar-sets")
    groups = stored(components(confirmed(first, ends, sets)), "similar-groups").withColumnRenamed("id", "digest")
    open_now = entries.join(ends.select("digest"), "digest", "left_semi").join(groups, "digest", "left").withColumn(
        "component", F.coalesce("component", "digest"))
    more = settled(stored(open_entries(open_now, block), "similar-open"), sets)
    joined = stored(components(more), "similar-joined").select(F.col("id").alias("component"), F.col("component").alias("top"))
    named = (
        classes.select("digest", "rep").join(groups, "digest", "left")
        .withColumn("component", F.coalesce("component", "digest")).join(joined, "component", "left")
        .select("digest", "rep", F.coalesce("top", "component").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = stored(named.join(least, "component").select("digest", F.col("least").alias("component")), "similar-named")
    return marked.select("doc_id", "digest").join(named, "digest").select("doc_id", "component")


def near_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, component): documents joined by SimHash links or by similar shingle sets.

    The first are the links of `simhash.close_links`, from the range join over segment counts; the
    second add what lies beyond their radius. component is the smallest doc_id of the group.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    marked = simhash_groups(plain).select("doc_id", "component")
    both = stored(marked.union(similar_groups(docs, block)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("component").cast("long").alias("component")), "near-both")
    groups = components(both.where("doc_id <> component").select(
        F.col("component").alias("a"), F.col("doc_id").alias("b")).distinct())
    ids = both.select("doc_id").distinct()
    return ids.join(groups, ids.doc_id == groups.id, "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("component"))


def drop_similar(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (one of its repeated rows).

    Rows without doc_id cannot be told apart from the document that stays, and are all kept.
    """
    keep = near_groups(docs, block).where("doc_id = component").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").withColumn("__row", F.row_number().over(_by_doc()))
    return kept.where("__row = 1").drop("__row").select(*docs.columns).union(docs.where("doc_id is null"))
