"""Benchmark decontamination with SimHash of item-sized windows.

Items and windows of documents are multisets of five-word shingles. A window of the size of an
item gets a 64-bit SimHash weighted by those counts; a multi-index over blocks of the items'
fingerprints gives every item within RADIUS bits, and the weighted Jaccard similarity of the
multisets decides. Windows with too few shingles of the benchmark cannot reach the similarity by
counting alone, so no fingerprint is made for them; this bound loses nothing. Windows of one size
look up the items of that size only.

The benchmark is the stated query set. It is dealt into blocks of bounded text, and each block
goes over all documents, so what a task holds does not grow with the benchmark.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import stored

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20  # a pair of similarity 0.8 differs in 9.7 of 64 bits, standard deviation 2.9
INDEX_BLOCKS = 8  # of 8 bits; within RADIUS one block differs in at most RADIUS // 8 bits
BLOCK_CHARS = 4_000_000  # text of the benchmark in one block
CACHED_WORDS = 400_000
PART = 1 << 20  # shingles of a document that are looked at in one piece
MATCH = "item_id long, similarity double, first_word long, words int"
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingle_hashes(text: str | None, words: _Words) -> tuple[np.ndarray, int]:
    """Hash of every shingle in order, and the number of words. A shorter text is one shingle."""
    found = _WORD.findall(text.lower()) if text else []
    n = len(found)
    if not n:
        return np.zeros(0, dtype=np.uint64), 0
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=n)
    size = min(SHINGLE, n)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out *= _MIX
        out += h[k: n - size + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29)), n


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)


class Marks:
    """Multi-index over the fingerprints of the items of one size.

    For each block of the bits and each of its values a set of items, one bit each in words of 64,
    whose block is near enough; of two fingerprints within the radius one block at least is.
    """

    def __init__(self, items: np.ndarray, marks: np.ndarray, radius: int):
        self.items, self.marks, self.radius = items, marks[items], radius
        width = 64 // INDEX_BLOCKS
        values = np.arange(1 << width, dtype=np.uint64)
        self.sets = []
        for at in range(0, len(items), 64):
            bit = np.uint64(1) << np.arange(len(self.marks[at:at + 64]), dtype=np.uint64)
            self.sets.append([
                (np.bitwise_count(values[:, None] ^ (self.marks[None, at:at + 64] >> np.uint64(k * width)) & values[-1])
                 <= radius // INDEX_BLOCKS) @ bit for k in range(INDEX_BLOCKS)])

    def within(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in marks, item) of all pairs within the radius, by the pigeonhole bound."""
        parts = marks.astype("<u8").view(np.uint8).reshape(-1, INDEX_BLOCKS)
        at, found = [], []
        for k, sets in enumerate(self.sets):
            some = sets[0][parts[:, 0]]
            for block in range(1, INDEX_BLOCKS):
                some = some | sets[block][parts[:, block]]
            rows = np.flatnonzero(some)
            own = self.marks[64 * k:64 * k + 64]
            listed = (some[rows, None] >> np.arange(len(own), dtype=np.uint64)) & np.uint64(1) > 0
            row, item = np.nonzero(listed & (np.bitwise_count(marks[rows, None] ^ own) <= self.radius))
            at.append(rows[row])
            found.append(self.items[64 * k + item])
        return np.concatenate(at), np.concatenate(found)


class Items:
    """A block of benchmark items with their fingerprints and an index over those of each size."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float = SIMILARITY, radius: int = RADIUS):
        self.words, self.similarity, self.radius = _Words(), similarity, radius
        self.ids, self.bags, self.n_words, marks = [], [], [], []
        for item_id, text in rows:
            hashes, n = shingle_hashes(text, self.words)
            if n:
                self.ids.append(item_id)
                self.n_words.append(n)
                self.bags.append(Counter(hashes.tolist()))
                marks.append(_pack((_bits(hashes).sum(axis=0) * 2 > len(hashes))[None])[0])
        self.marks = np.array(marks, dtype=np.uint64)
        self.sizes = np.array([b.total() for b in self.bags], dtype=np.int64)
        self.all = np.unique(np.array([h for b in self.bags for h in b], dtype=np.uint64))
        self.maybe = np.zeros(1 << 22, dtype=bool)  # 4 MB; a first test before the exact one
        self.maybe[self.all >> np.uint64(42)] = True
        self.by_size = {int(n): Marks(np.flatnonzero(self.sizes == n), self.marks, radius) for n in np.unique(self.sizes)}

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        hit = self.maybe[hashes >> np.uint64(42)]
        at = np.flatnonzero(hit)
        if len(at):
            where = np.minimum(np.searchsorted(self.all, hashes[at]), len(self.all) - 1)
            hit[at] = self.all[where] == hashes[at]
        return hit

    def matches(self, text: str | None) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of the best window of each item found."""
        hashes, n = shingle_hashes(text, self.words)
        best: dict[int, tuple[float, int]] = {}
        if not len(hashes) or not len(self.marks):
            return []
        hit = self.hits(hashes)
        if not hit.any():
            return []
        before = np.concatenate([[0], np.cumsum(hit)])
        for size, index in self.by_size.items():
            w = min(size, len(hashes))
            least = self.similarity * (size + w) / (1 + self.similarity)
            starts = np.flatnonzero(before[w:] - before[:-w] >= least - 1e-9)
            for part in self._runs(starts, w):
                first, last = int(part[0]), int(part[-1]) + w
                sums = np.zeros((last - first + 1, 64), dtype=np.int32)
                np.cumsum(_bits(hashes[first:last]), axis=0, dtype=np.int32, out=sums[1:])
                at = part - first
                marks = _pack((sums[at + w] - sums[at]) * 2 > w)
                bag_of = None
                for nth, k in zip(*(x.tolist() for x in index.within(marks))):
                    start = int(part[nth])
                    if bag_of != start:
                        bag_of, bag = start, Counter(hashes[start:start + w].tolist())
                    common = (bag & self.bags[k]).total()
                    found = common / (w + size - common)
                    if found >= self.similarity and found > best.get(k, (0.0, 0))[0]:
                        best[k] = (found, start)
        return [(self.ids[k], s, at, self.n_words[k]) for k, (s, at) in sorted(best.items())]

    @staticmethod
    def _runs(starts: np.ndarray, width: int):
        """Window starts in pieces that lie close together."""
        at = 0
        while at < len(starts):
            end = int(np.searchsorted(starts, starts[at] + (1 << 16)))
            gap = np.flatnonzero(np.diff(starts[at:end]) > width)
            end = at + int(gap[0]) + 1 if len(gap) else end
            yield starts[at:end]
            at = end


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about `chars` characters of text."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // chars)
    for k in range(n):
        own = F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k
        rows = [(r["item_id"], r["text"]) for r in items.where(own).collect()]
        yield sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, words): items that documents contain.

    One row per document and item: the best window, the first one of equals. Null or blank texts
    and items match nothing. Repeated documents or items count once by their ids; further
    columns are ignored. Empty tables give no rows. A document shorter than an item is compared
    whole. An item of fewer than five words is one shingle of its own length, so it matches only
    texts that are as short; inside longer texts no five-word similarity with it is defined.
    The matches of each block of items are stored before the next one goes over the documents.
    """
    found = None
    for k, rows in enumerate(blocks(benchmark)):
        if k == 1:
            found = stored(found, "leaks-0")
        part = _leaks_of(docs, rows, similarity)
        found = part if found is None else found.union(stored(part, f"leaks-{k}"))
    if found is None:
        found = docs.select(F.col("doc_id").cast("long")).where("false").selectExpr(
            "doc_id", "0L AS item_id", "0D AS similarity", "0L AS first_word", "0 AS words")
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("later"), "words"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select(
        "doc_id", "item_id", "b.similarity", (-F.col("b.later")).alias("first_word"), "b.words")


def _leaks_of(docs: DataFrame, rows: list, similarity: float) -> DataFrame:
    def each(batches):
        import pyarrow as pa

        items = Items(rows, similarity)
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32()]
        for batch in batches:
            out = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                   for m in items.matches(text.as_py())]
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["doc_id", "item_id", "similarity", "first_word", "words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        each, "doc_id long, item_id long, similarity double, first_word long, words int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of docs that contain no item of the benchmark. Nothing is shuffled.

    What is left after a block of items is stored before the next one, so a plan holds one block.
    Null and blank texts contain nothing; repeated rows and rows without doc_id are judged alike.
    """
    for k, rows in enumerate(blocks(benchmark)):
        docs = (docs if k == 0 else stored(docs, f"clean-{k}")).where(~_contains(rows, similarity)(F.col("text")))
    return docs


def _contains(rows: list, similarity: float):
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items = Items(rows, similarity)
        for batch in texts:
            yield pd.Series([bool(items.matches(t)) for t in batch], dtype=bool)

    return F.pandas_udf(each, "boolean")
