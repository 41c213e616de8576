"""Packing documents into sequences by large-item matching.

The plan needs only how many pieces have each length (at most `capacity` numbers, summed by
Spark), so it is made from that histogram and its size does not grow with the corpus: pieces
above a third of the capacity are paired, two to a sequence at most, and smaller ones fill the
tightest gaps. Each piece then finds its place from its length and its rank among equal lengths.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtide.llm.common import stored, word_slices

CAPACITY = 4096
END_ID = 1
CACHED_WORDS = 1_000_000  # per Python worker, some 200 MB; the cache starts anew beyond it
LONG_WORD = 64  # bytes; longer ones are not kept
MARKS = b".,;:!?"
_MAY_COMPOSE = re.compile(rb"[A-Z][\x80-\xff]")  # before another ASCII byte a letter stands alone
GROUP = 1 << 18  # bytes of text encoded together
PIECES = "doc_id long, piece int, start long, length int, ids binary, part int, nth long"


class _Encoder(dict):
    """Word -> its ids as little-endian uint32 bytes.

    The tokenizer composes, lowers the case, and drops white space before it merges, so a text's
    ids are those of its words, and ASCII words that differ in A-Z only have the same ids. In other
    words a mark behind a letter may compose with one case alone, so those keep their case. Special
    tokens are told by their case, so texts that may hold one keep it.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.merges = self.tokenizer.model

    def plain(self, word: bytes) -> bytes:
        """Ids of a-z letters, or of one mark: a token run that only the merges are left to do for.

        (Neither the composition nor the byte alphabet of the tokenizer changes these; a mark
        behind a letter is a run of its own.)
        """
        return array("I", [t.id for t in self.merges.tokenize(word.decode("ascii"))]).tobytes()

    def texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text (UTF-8); the texts are held in memory together."""
        words: list[bytes] = []
        ends = [0]
        for data in texts:
            if b"<|" in data:
                words += data.split()
            elif _MAY_COMPOSE.search(data):
                words += [w.lower() if w.isascii() else w for w in data.split()]
            else:
                words += data.lower().split()
            ends.append(len(words))
        found = list(map(self.get, words))
        if None in found:
            new = list({w for w, ids in zip(words, found) if ids is None})
            if len(self) + len(new) > CACHED_WORDS:
                self.clear()
            got = {w: self.plain(w) for w in new if w.isalpha() and w.islower()}
            got |= {w: self.plain(w[:-1]) + self.plain(w[-1:]) for w in new if w[-1] in MARKS and w[:-1].isalpha() and w.islower()}
            rest = [w for w in new if w not in got]
            for word, one in zip(rest, self.tokenizer.encode_batch_fast(
                    [w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)):
                got[word] = array("I", one.ids).tobytes()
            found = [ids if ids is not None else got[w] for w, ids in zip(words, found)]
            self.update(got if max(map(len, new)) <= LONG_WORD else {
                w: ids for w, ids in got.items() if len(w) <= LONG_WORD})
        return [b"".join(found[i:j]) for i, j in zip(ends, ends[1:])]


def _encoder(path: str) -> _Encoder:
    """The encoder of this Python worker; it outlives the task, and so do the words it knows."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_fieldtide_encoders", {})
    if path not in kept:
        kept.clear()
        kept[path] = _Encoder(path)
    return kept[path]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: (doc_id, piece, start, length, ids, part, nth).

    Ids of the whole text, then end_id, cut every `capacity` ids. Null text: end_id alone.
    ids: little-endian uint32. (part, nth): task and count among its pieces of that length; they
    are numbered while the piece is written, so a repeated task writes the same or is discarded.
    Repeated rows are documents of their own.
    """
    def each(batches):
        import os

        import pyarrow as pa
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4").tobytes()
        names = [f.split()[0] for f in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]

        def cut(rows):
            out = []
            for (doc_id, _), ids in zip(rows, encoder.texts([t for _, t in rows])):
                out += pieces_of(doc_id, ids + end)
            return batch_of(out)

        def pieces_of(doc_id, ids):
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                own = ids[at:at + 4 * capacity]
                length = len(own) // 4
                yield doc_id, piece, at // 4, length, own, part, int(seen[length])
                seen[length] += 1

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, held = [], 0
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                data = text.as_py() or b""
                if len(data) > GROUP:  # a long text alone, in slices
                    ids = b"".join(x for p in word_slices(data, GROUP) for x in encoder.texts([p]))
                    yield batch_of(list(pieces_of(doc_id, ids + end)))
                    continue
                rows.append((doc_id, data))
                held += len(data)
                if held > GROUP:
                    yield cut(rows)
                    rows, held = [], 0
        if rows:
            yield cut(rows)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Places for counts[length] pieces of each length, as rows
    (length, first_rank, pieces, per_sequence, first_sequence, offset).

    A row puts `pieces` pieces of that length, by rank, `per_sequence` next to each other from
    `offset` on in consecutive sequences. Every step uses up a length or a kind of gap, so the
    number of rows depends on the capacity, not on the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    rows, gaps, gap_sizes = [], {}, []
    sequences = 0

    def place(length: int, pieces: int, per: int, sequence: int, offset: int) -> None:
        rows.append((length, rank[length], pieces, per, sequence, offset))
        rank[length] += pieces
        left[length] -= pieces

    def add_gap(gap: int, sequence: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(gap_sizes, gap)
            gaps[gap].append((sequence, count))

    third = capacity // 3
    large = sorted(n for n in left if n > third)
    for a in reversed(large):
        while left[a]:
            b = min(a, capacity - a)
            k = bisect_left(large, b + 1) - 1  # the largest partner that fits
            while k >= 0 and left[large[k]] < 1 + (large[k] == a):
                k -= 1
            partner = large[k] if k >= 0 else 0
            times = left[a]
            if partner:
                times = left[a] // 2 if partner == a else min(left[a], left[partner])
            place(a, times, 1, sequences, 0)
            if partner:
                place(partner, times, 1, sequences, a)
            add_gap(capacity - a - partner, sequences, times)
            sequences += times

    for s in sorted((n for n in left if n <= third), reverse=True):
        while left[s]:
            k = bisect_left(gap_sizes, s)
            if k < len(gap_sizes):  # the tightest gap, filled while pieces fit
                gap = gap_sizes[k]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    gap_sizes.pop(k)
            else:
                gap, first, count = capacity, sequences, None
            per = gap // s
            whole = left[s] // per if count is None else min(count, left[s] // per)
            if whole:
                place(s, whole * per, per, first, capacity - gap)
                add_gap(gap - per * s, first, whole)
            used, rest = whole, left[s]
            if rest and rest < per and (count is None or whole < count):
                place(s, rest, rest, first + whole, capacity - gap)
                add_gap(gap - rest * s, first + whole, 1)
                used += 1
            if count is None:
                sequences += used
            else:
                add_gap(gap, first + used, count - used)
    out = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (length, part, nth, ...) with sequence_id and offset; the ids are not looked at."""
    by_part = pieces.groupBy("part", "length").count()
    totals = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    rows = plan(totals, capacity)
    keys = (rows[:, 0] << 45) + rows[:, 1]

    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        row = rows[np.searchsorted(keys, (length.to_numpy(np.int64) << 45) + rank.to_numpy(np.int64), "right") - 1]
        at = rank.to_numpy(np.int64) - row[:, 1]
        return pd.DataFrame({
            "sequence_id": row[:, 4] + at // row[:, 3],
            "offset": row[:, 5] + at % row[:, 3] * row[:, 0]})

    places = F.pandas_udf(where, "sequence_id long, offset long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select(
        "part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(starts, ["part", "length"])
    return (
        ranked.withColumn("place", places("length", F.col("earlier") + F.col("nth")))
        .select(*pieces.columns, "place.sequence_id", "place.offset")
    )


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids, sequence_id, offset.

    docs: doc_id, text; further columns are ignored. No documents, no rows.
    """
    return assign(stored(tokenize(docs, tokenizer, capacity, end_id), "pieces"), capacity).drop("part", "nth")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, starts): the sequences, at most `capacity` ids each."""
    return packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("p")
    ).select(
        "sequence_id",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y["ids"])).alias("ids"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
        F.transform("p", lambda x: x["offset"]).alias("starts"))
