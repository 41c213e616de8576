"""SimHash near-duplicates through segment bit counts.

Two fingerprints that differ in d bits have segment bit counts whose Manhattan distance is at
most d. So all pairs within a radius lie within that Manhattan distance in the space of the
counts, and the range join there loses nothing; the few pairs it gives are verified on the bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import components, forest, grouped_batches, pair_blocks, stored

RADIUS = 3
SEGMENTS = 16  # of 4 bits each
GROUPS = 8  # of two segments each; at most RADIUS of them can differ
PART = 100_000  # shingles of a text that are hashed in one piece
BLOCK = 1000  # entries of a grid cell that are compared in one piece
BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash: a bit is set where over half of the shingle hashes have it."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    total, seen = max(len(words) - shingle + 1, 1), np.zeros(2048, dtype=np.int64)
    for at in range(0, total, PART):
        own = words[at:at + PART + shingle - 1]
        shingles = map(b" ".join, zip(*(own[i:] for i in range(shingle)))) if len(own) >= shingle else [b" ".join(own)]
        data = np.frombuffer(b"".join([digest(s, 42) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
        seen += np.bincount((data + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    count = seen.reshape(8, 256) @ BITS
    return int.from_bytes(np.packbits(count.ravel() * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) of every document. Null or blank text: zero."""
    def each(batches):
        import pyarrow as pa

        for batch in batches:
            marks = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, fingerprint long")


def segment_counts(marks: np.ndarray) -> np.ndarray:
    """Set bits of each 4-bit segment: the point of a fingerprint in the grid."""
    shifts = np.arange(0, 64, 64 // SEGMENTS, dtype=np.uint64)
    return np.bitwise_count((marks[:, None] >> shifts) & np.uint64((1 << (64 // SEGMENTS)) - 1))


def _cells(marks: np.ndarray, radius: int) -> np.ndarray:
    """Grid cells in which each point meets all others within the Manhattan radius.

    Points at distance <= radius agree in at least GROUPS - radius of the axis groups, so
    they share the cell on the axes of one choice of that many groups.
    """
    per = SEGMENTS // GROUPS
    code = np.zeros((len(marks), GROUPS), dtype=np.uint64)
    counts = segment_counts(marks).astype(np.uint64).reshape(len(marks), GROUPS, per)
    for k in range(per):
        code = code * np.uint64(5) + counts[:, :, k]
    out = []
    for number, chosen in enumerate(combinations(range(GROUPS), GROUPS - radius)):
        cell = np.full(len(marks), number, dtype=np.uint64)
        for g in chosen:
            cell = cell * np.uint64(5**per) + code[:, g]
        out.append(cell)
    return np.stack(out, axis=1)


def _close_forest(table, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the verified pairs among sorted entries: same cell, counts near, bits near.

    Pairs come by distance of their rows; what earlier ones have joined is not looked at again,
    so no task holds the pairs of a cell.
    """
    cell, lo, hi, own = (table[c].to_numpy() for c in ("cell", "lo", "hi", "own"))
    marks = table["fingerprint"].to_numpy().view(np.uint64)
    counts = segment_counts(marks).astype(np.int8)
    nodes, where = np.unique(table["rep"].to_numpy(), return_inverse=True)
    label = np.arange(len(nodes))
    new = np.ones(len(cell), dtype=bool)
    new[1:] = (cell[1:] != cell[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    group = np.cumsum(new)
    at, k = np.arange(len(cell)), 0
    while len(at):
        k += 1
        at = at[at + k < len(cell)]
        at = at[group[at] == group[at + k]]
        near = at[(lo[at] == hi[at]) | (own[at] != own[at + k])]
        near = near[label[where[near]] != label[where[near + k]]]
        near = near[np.abs(counts[near] - counts[near + k]).sum(axis=1) <= radius]
        near = near[np.bitwise_count(marks[near] ^ marks[near + k]) <= radius]
        if len(near):
            label = forest(len(nodes), label[where[near]], label[where[near + k]])[label]
    tied = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[tied]], nodes[tied]


def close_links(marks: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints within the radius.

    marks: (fingerprint, rep), one row each. Within a cell block the verified pairs are reduced
    to a spanning forest, so a group of n near copies gives n - 1 links, not n^2.
    """
    if not 0 <= radius < GROUPS:
        raise ValueError(f"radius must be below {GROUPS}")

    def spread(batches):
        import pyarrow as pa

        for batch in batches:
            cells = _cells(batch.column(0).to_numpy().view(np.uint64), radius)
            times = np.repeat(np.arange(len(cells)), cells.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.ravel().view(np.int64)), batch.column(0).take(pa.array(times)),
                 batch.column(1).take(pa.array(times))], ["cell", "fingerprint", "rep"])

    def verify(batches):
        import pyarrow as pa

        for table in grouped_batches(batches, ("cell", "lo", "hi")):
            yield pa.RecordBatch.from_arrays(
                [pa.array(ends, pa.int64()) for ends in _close_forest(table, radius)], ["a", "b"])

    entries = marks.select("fingerprint", "rep").mapInArrow(spread, "cell long, fingerprint long, rep long")
    return (
        pair_blocks(entries, "cell", "rep", block)
        .repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi")
        .mapInArrow(verify, "a long, b long")
    )


def simhash_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component): documents linked by fingerprints within the radius.

    component is the smallest doc_id of the group. Equal fingerprints are one class, so exact
    copies cost one entry in the search. Documents without words have fingerprint zero and are
    linked like any other. Repeated rows stay rows; rows of one doc_id are one document. Rows
    without doc_id get the component of their fingerprint, null if no row there has an id. Other
    columns of docs are not looked at.
    """
    marked = stored(fingerprints(docs, shingle), "simhash")
    classes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    groups = components(close_links(classes.where("rep is not null"), radius))
    named = classes.join(groups, classes.rep == groups.id, "left").select(
        "fingerprint", F.coalesce("component", "rep").alias("component"))
    return marked.join(stored(named, "simhash-groups"), "fingerprint").select(
        "doc_id", "fingerprint", "component")


def hex16(mark) -> F.Column:
    return F.lower(F.lpad(F.hex(mark), 16, "0"))


def drop_near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the one with the smallest doc_id (one of its repeated rows).

    Rows without doc_id cannot be told apart from the document that stays, and are all kept.
    """
    keep = simhash_groups(docs, radius).where("doc_id = component").select("doc_id").distinct()
    once = F.row_number().over(_by_doc())
    kept = docs.join(keep, "doc_id", "left_semi")
    kept = kept.withColumn("__row", once).where("__row = 1").drop("__row").select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))


def _by_doc():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("text")
