"""Ranked lexical search over an index in strata of equal length normaliser.

A document's score for an item sums, over the item's terms, the term's weight times an impact
that depends on the term's count tf in the document and on the document's normaliser m alone. In a
stratum, documents of one m, an impact is therefore computed once per tf; the postings of a term
are kept by falling tf, and the largest tf of each term bounds the score of every document of the
stratum. Strata are visited by falling bound until none can hold one of the best any more.

Strata of many postings are cut into blocks, so a hot m is no hot group. A task ranks the blocks it
reads for all items; of its rows only the best of each item leave it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.llm.common import grouped_batches, stored

BEST = 20
BLOCK_POSTINGS = 1 << 17  # postings of a block, in expectation; some 1 MB
BLOCK_DOCS = 1000  # documents of a block, in expectation
OPEN_STRATA = 64  # strata rows ranked together, some 130 MB when all are opened
BLOCK_CHARS = 4_000_000  # text of the items that go over the index together
STRATUM = ("m long, block int, docs binary, terms binary, dfs binary, most binary, runs binary, "
           "run_tf binary, run_docs binary, places binary")
# Separators are the ASCII characters that are no letter and no digit; only A-Z are lowered.
_PLAIN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_PLAIN).split() if text else []


class Index(NamedTuple):
    """strata: rows of STRATUM; n_docs: documents with terms (N); n_terms: their terms (L)."""

    strata: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, block: int = BLOCK_POSTINGS) -> Index:
    """The index of all documents with a doc_id and at least one term, stored in the shared folder.

    A stratum row: its documents by id; its terms by name with their numbers of documents, largest
    tf and numbers of runs; the runs (tf, documents) of each term by falling tf; and the places
    of the documents of all runs. Null or blank texts and rows without doc_id are not in it;
    repeated rows are documents of their own; further columns are ignored.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def measure(batches):
        import pyarrow as pa

        found: Counter = Counter()
        postings: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                own = terms_of(text.as_py())
                if own:
                    found[len(own)] += 1
                    postings[len(own)] += len(set(own))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (list(found), list(found.values()), [postings[n] for n in found])],
            ["n", "docs", "postings"])

    lengths = stored(
        texts.select("text").mapInArrow(measure, "n long, docs long, postings long")
        .groupBy("n").agg(F.sum("docs").alias("docs"), F.sum("postings").alias("postings")), "search-lengths")
    total = lengths.agg(F.sum("docs"), F.sum(F.col("n") * F.col("docs"))).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    m = F.expr(f"75 + cast((25bd * n * {n_docs}bd) div {max(n_terms, 1)}bd as bigint)")
    blocks = F.ceil(F.greatest(F.sum("postings") / block, F.sum("docs") / BLOCK_DOCS)).cast("int")
    hot = lengths.groupBy(m.alias("m")).agg(blocks.alias("blocks")).where("blocks > 1")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = terms_of(text.as_py())
                if own:
                    times = Counter(own)
                    tf = np.fromiter(times.values(), "<u4", len(times))
                    rows.append((75 + 25 * len(own) * n_docs // n_terms, doc_id, b" ".join(times), tf.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.binary()] * 2)],
                    ["m", "doc_id", "terms", "tf"])

    counted = texts.mapInArrow(count, "m long, doc_id long, terms binary, tf binary")
    dealt = (
        counted.withColumn("row", F.monotonically_increasing_id()).join(hot, "m", "left")
        .withColumn("block", F.pmod("row", F.coalesce("blocks", F.lit(1))).cast("int"))
        .select("m", "block", "doc_id", "terms", "tf")
    )

    def build(batches):
        import pyarrow as pa

        for table in grouped_batches(batches, ("m", "block"), rows=4000):
            m, block = table["m"].to_numpy(), table["block"].to_numpy()
            change = np.flatnonzero((m[1:] != m[:-1]) | (block[1:] != block[:-1])) + 1
            for i, j in zip([0, *change.tolist()], [*change.tolist(), len(m)]):
                own = table.slice(i, j - i)
                row = (int(m[i]), int(block[i]), *_stratum(
                    own["doc_id"].to_numpy(), own["terms"].to_pylist(), own["tf"].to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], t) for v, t in zip(row, [pa.int64(), pa.int32()] + [pa.binary()] * 8)],
                    [f.split()[0] for f in STRATUM.split(", ")])

    strata = (
        dealt.repartition("m", "block").sortWithinPartitions("m", "block", "doc_id").mapInArrow(build, STRATUM))
    return Index(stored(strata, "search-index"), n_docs, n_terms)


def _stratum(docs: np.ndarray, terms: list[bytes], tf: list[bytes]) -> list[bytes]:
    """Binary columns of one stratum row, from documents sorted by id."""
    named = b" ".join(terms).split(b" ")
    names = sorted(set(named))
    number = dict(zip(names, range(len(names))))
    term = np.fromiter(map(number.__getitem__, named), np.int64, len(named))
    times = np.frombuffer(b"".join(tf), "<u4").astype(np.int64)
    place = np.repeat(np.arange(len(docs)), [len(t) // 4 for t in tf])
    order = np.lexsort((place, -times, term))
    term, times, place = term[order], times[order], place[order]
    first = np.concatenate([[True], (term[1:] != term[:-1]) | (times[1:] != times[:-1])])
    at = np.flatnonzero(first)
    run_docs = np.diff(np.append(at, len(term)))
    dfs, runs = np.bincount(term), np.bincount(term[at])
    most = times[np.cumsum(dfs) - dfs]
    small = (dfs, most, runs, times[at], run_docs, place)
    return [docs.astype("<i8").tobytes(), b" ".join(names), *(x.astype("<u4").tobytes() for x in small)]


def item_blocks(items: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int | None, str]]]:
    """The distinct (item_id, text) in blocks of about `chars` characters of text."""
    own = items.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long"), "text").distinct()
    total = own.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-total // chars)
    for k in range(n):
        yield [(r[0], r[1]) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()]


class Items:
    """A block of items as one list of (term, count) entries, item after item."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        bags = [(item_id, Counter(terms_of(text))) for item_id, text in rows]
        bags = [(item_id, bag) for item_id, bag in bags if bag]
        self.ids = [item_id for item_id, _ in bags]
        self.number: dict[bytes, int] = {}
        self.term = np.array([self.number.setdefault(t, len(self.number)) for _, bag in bags for t in bag], dtype=np.int64)
        self.times = np.array([n for _, bag in bags for n in bag.values()], dtype=np.int64)
        self.ends = np.cumsum([len(bag) for _, bag in bags], dtype=np.int64)
        self.starts = self.ends - np.array([len(bag) for _, bag in bags], dtype=np.int64)


def _numbers(data: bytes, kind: str = "<u4") -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64)


def document_counts(index: Index, items: Items) -> np.ndarray:
    """In how many documents each term of the items occurs. Only names and counts are read."""
    number = items.number

    def count(batches):
        import pyarrow as pa

        found = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for names, dfs in zip(batch.column(0), batch.column(1)):
                at = [(number[t], i) for i, t in enumerate(names.as_py().split(b" ")) if t in number]
                if at:
                    own, where = np.array(at).T
                    found[own] += _numbers(dfs.as_py())[where]
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["term", "docs"])

    rows = index.strata.select("terms", "dfs").mapInArrow(count, "term long, docs long")
    out = np.zeros(len(number), dtype=np.int64)
    for r in rows.groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[r["term"]] = r["docs"]
    return out


class Stratum:
    """One stratum row, opened for the terms of the items."""

    def __init__(self, row: dict, items: Items):
        self.m, self.docs = row["m"], np.frombuffer(row["docs"], "<i8")
        found = [(items.number[t], i) for i, t in enumerate(row["terms"].split(b" ")) if t in items.number]
        own, where = np.array(found, dtype=np.int64).reshape(-1, 2).T
        self.slot = np.full(len(items.number), -1, dtype=np.int64)
        self.slot[own] = np.arange(len(own))
        self.most = np.zeros(len(items.number), dtype=np.int64)
        self.most[own] = self.impact(_numbers(row["most"])[where])
        dfs, runs = _numbers(row["dfs"]), _numbers(row["runs"])
        self.df, self.first, self.run, self.runs = dfs[where], (np.cumsum(dfs) - dfs)[where], (np.cumsum(runs) - runs)[where], runs[where]
        self.row, self.open = row, None

    def impact(self, tf: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 12 * self.m)

    def scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Score of every document of the stratum for one item."""
        if self.open is None:  # impacts once per tf, then dealt to the runs' documents
            self.open = (_numbers(self.row["places"]), np.repeat(
                self.impact(_numbers(self.row["run_tf"])), _numbers(self.row["run_docs"])))
            self.row = None
        places, impacts = self.open
        slots = self.slot[terms]
        there = slots >= 0
        slots, weights = slots[there], weights[there]
        df = self.df[slots]
        at = np.arange(df.sum()) + np.repeat(self.first[slots] - (np.cumsum(df) - df), df)
        out = np.zeros(len(self.docs), dtype=np.int64)
        np.add.at(out, places[at], impacts[at] * np.repeat(weights, df))
        return out


class Ranking:
    """The best documents of each item among the strata seen so far."""

    def __init__(self, items: Items, weights: np.ndarray, best: int):
        self.items, self.best = items, best
        self.weight = weights[items.term] * items.times
        self.docs = [np.zeros(0, dtype=np.int64) for _ in items.ids]
        self.score = [np.zeros(0, dtype=np.int64) for _ in items.ids]
        self.visited = 0

    def see(self, strata: list[Stratum]) -> None:
        items = self.items
        bounds = np.stack([np.add.reduceat(self.weight * s.most[items.term], items.starts) for s in strata])
        for q in range(len(items.ids)):
            own = slice(items.starts[q], items.ends[q])
            for k in np.argsort(-bounds[:, q], kind="stable").tolist():
                least = self.score[q][-1] if len(self.score[q]) == self.best else 1
                if bounds[k, q] < least:
                    break
                self.visited += 1
                found = strata[k].scores(items.term[own], self.weight[own])
                some = np.flatnonzero(found >= least)
                docs = np.concatenate([self.docs[q], strata[k].docs[some]])
                score = np.concatenate([self.score[q], found[some]])
                order = np.lexsort((docs, -score))[:self.best]
                self.docs[q], self.score[q] = docs[order], score[order]


def search(index: Index, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the `best` documents of each item with a score above 0.

    Equal scores rank by ascending doc_id. Rows of one doc_id are documents of their own; repeated
    items count once, other texts of one item_id are items of their own; null and blank items and
    items without any document give no rows; further columns are ignored.
    """
    spark, found = index.strata.sparkSession, None
    for k, rows in enumerate(item_blocks(items)):
        part = stored(_ranked(index, Items(rows), best), f"search-{k}")
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def _ranked(index: Index, items: Items, best: int) -> DataFrame:
    spark = index.strata.sparkSession
    df = document_counts(index, items) if items.ids and index.n_docs else None
    if df is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    weights = np.array([
        math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)

    def rank(batches):
        import pyarrow as pa

        found = Ranking(items, weights, best)
        for batch in batches:
            for at in range(0, batch.num_rows, OPEN_STRATA):
                found.see([Stratum(row, items) for row in batch.slice(at, OPEN_STRATA).to_pylist()])
        nth = np.repeat(np.arange(len(items.ids)), [len(d) for d in found.docs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(nth), pa.array(np.concatenate(found.docs)), pa.array(np.concatenate(found.score))],
            ["nth", "doc_id", "score"])

    order = Window.partitionBy("nth").orderBy(F.col("score").desc(), "doc_id")
    names = spark.createDataFrame(list(enumerate(items.ids)), "nth long, item_id long")
    local = index.strata.mapInArrow(rank, "nth long, doc_id long, score long")
    return (
        local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        .join(F.broadcast(names), "nth").select("item_id", "rank", "doc_id", "score")
    )
