"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece of text has one valid last token: the only token at its end that fits the
last token of the prefix before it. Two tokens fit if the merges of their joined bytes give just
these two back, and a row of tokens is the encoding if all neighbours in it fit. So a table of
one token per byte holds the encodings of all prefixes of a piece: text that is appended only
extends the table, and after an edit the pieces before it and behind the next common piece end
stay as they are.

The pattern that cuts a text into pieces looks at most two characters past a piece's end and
never back; that is what makes the restart before an edit and the stop behind it exact.
"""

from __future__ import annotations

import base64
from array import array
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHED_PIECES = 1_000_000  # per Python worker, some 200 MB; the cache starts anew beyond it
CACHED_PAIRS = 2_000_000
LONG_PIECE = 64  # bytes; longer pieces are not kept
SPAN = 1 << 16  # pieces or ids handled together
TABLE = "doc_id long, text string, ids binary, last binary, piece_chars binary, piece_bytes binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder(dict):
    """Piece of text -> its ids as little-endian uint32 bytes; a bounded cache of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """Ids of a few bytes by their merges, the smallest rank first, the leftmost of equals."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            joined = [self.ranks.get(a + b, len(self.tokens)) for a, b in zip(parts, parts[1:])]
            least = min(joined)
            if least == len(self.tokens):
                break
            at = joined.index(least)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` in an encoding; left is -1 at the start of a piece."""
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) >= CACHED_PAIRS:
                self.known.clear()
            own = [left, right] if left >= 0 else [right]
            found = self.known[left, right] = self.merged(b"".join(map(self.tokens.__getitem__, own))) == own
        return found

    def extend(self, data: bytes, last: array) -> array:
        """last: the last token of each of the first len(last) prefixes of data; filled up."""
        begin = max(0, len(last) - self.longest)
        done = len(last)
        for end, (token, length) in self.ends.iter(data.decode("latin-1"), begin):
            if end == done:
                start = end - length
                if self.fits(last[start] if start >= 0 else -1, token):
                    last.append(token)
                    done += 1
        return last

    def backwards(self, last: array) -> array:
        """The tokens of a whole piece from its table."""
        out, at = array("I"), len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        out.reverse()
        return out

    def table(self, data: bytes, last: array | None = None) -> array:
        """The table of a piece. A piece that is a token is that token even if merges do not make it."""
        last = self.extend(data, array("I") if last is None else last)
        whole = self.ranks.get(data)
        if whole is not None:
            last[-1] = whole
        return last

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        ids = (array("I", [whole]) if whole is not None else self.backwards(self.extend(data, array("I")))).tobytes()
        if len(data) <= LONG_PIECE:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if len(text) <= SPAN:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        found, pieces = [], (m[0] for m in self.pattern.finditer(text))
        while span := list(islice(pieces, SPAN)):
            found.append(b"".join(map(self.__getitem__, span)))
        return b"".join(found)

    def decoded(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, dtype="<u4")
        return b"".join(
            b"".join(map(self.tokens.__getitem__, own[at:at + SPAN].tolist())) for at in range(0, len(own), SPAN))

    def tables(self, text: str) -> tuple[array, array, array]:
        """(last, piece_chars, piece_bytes): tables of all pieces in a row, and the pieces' lengths."""
        last, chars, sizes = array("I"), array("I"), array("I")
        for m in self.pattern.finditer(text):
            data = m[0].encode("utf-8")
            last += self.table(data)
            chars.append(len(m[0]))
            sizes.append(len(data))
        return last, chars, sizes

    def ids_of(self, last: array, sizes: array) -> bytes:
        out, at = array("I"), 0
        for size in sizes:
            out += self.backwards(last[at:at + size])
            at += size
        return out.tobytes()

    def revised(self, text: str, last: array, chars: array, sizes: array, at: int, removed: int, added: str):
        """The text after an edit with its tables, and how many bytes had entries to keep.

        The edit takes `removed` characters away from `at` on and puts `added` there. Pieces that
        end two characters before it stay; from the first piece end behind it that was one before
        on, all stay. The piece the edit falls into keeps the entries of its unchanged prefix.
        """
        at = max(0, min(at, len(text)))
        removed = max(0, min(removed, len(text) - at))
        new = text[:at] + added + text[at + removed:]
        ends, byte_ends = np.cumsum(chars, dtype=np.int64), np.cumsum(sizes, dtype=np.int64)
        kept = int(np.searchsorted(ends, at - 1, "left"))  # pieces with end + 1 < at
        begin = int(ends[kept - 1]) if kept else 0
        byte = int(byte_ends[kept - 1]) if kept else 0
        shift, where = len(added) - removed, {int(e): i for i, e in enumerate(ends[kept:].tolist(), kept)}
        out = last[:byte], chars[:kept], sizes[:kept]
        old = text[begin:begin + chars[kept]].encode("utf-8") if kept < len(chars) else b""
        old_last, reused = last[byte:byte + len(old)], byte
        for m in self.pattern.finditer(new, begin):
            data = m[0].encode("utf-8")
            same = 0
            if m.start() == begin and old:
                limit = min(len(old), len(data))
                differ = np.flatnonzero(np.frombuffer(old[:limit], np.uint8) != np.frombuffer(data[:limit], np.uint8))
                same = int(differ[0]) if len(differ) else limit
                if old in self.ranks and same == len(old):
                    same -= 1  # the entry of a whole piece may be the token of its own rule
            reused += same
            out[0].extend(self.table(data, old_last[:same]))
            out[1].append(len(m[0]))
            out[2].append(len(data))
            match = where.get(m.end() - shift)
            if match is not None and m.end() >= at + len(added):
                rest = int(byte_ends[match])
                reused += len(last) - rest
                out[0].extend(last[rest:])
                out[1].extend(chars[match + 1:])
                out[2].extend(sizes[match + 1:])
                break
        return new, *out, reused


def _encoder(path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker. It lives in a module of its own that tasks do not bring
    along, so it and the pieces it knows outlive the task."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("_fieldtide_bpe", ModuleType("_fieldtide_bpe")).__dict__.setdefault("encoders", {})
    if (path, pattern) not in kept:
        kept.clear()
        kept[path, pattern] = Encoder(read_ranks(path), pattern)
    return kept[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids): little-endian uint32 ids of each whole text, pieces encoded one by one.

    No special tokens: their strings are text. Null or empty text: no ids. Repeated rows stay
    rows; null ids of documents stay null; further columns are ignored; no documents, no rows.
    A text is held in memory whole, its pieces in spans. With `decode` also `decoded`, the bytes
    of the ids.
    """
    def each(batches):
        import pyarrow as pa

        encoder = _encoder(ranks, pattern)
        for batch in batches:
            ids = [encoder.ids(t.as_py() or "") for t in batch.column(1)]
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([encoder.decoded(i) for i in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        each, "doc_id long, ids binary" + ", decoded binary" * decode)


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, data): the bytes of the ids of each row; null ids: no bytes."""
    def each(batches):
        import pyarrow as pa

        encoder = _encoder(ranks, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([encoder.decoded(i.as_py() or b"") for i in batch.column(1)], pa.binary())],
                ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, data binary")


def encode_tables(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Texts with their ids and prefix tables (columns of TABLE), to which edits can be applied.

    last: for every byte the last token of the prefix of its piece that ends there; piece_chars
    and piece_bytes: the lengths of the pieces. All are little-endian uint32.
    """
    def each(batches):
        import pyarrow as pa

        encoder = _encoder(ranks, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                last, chars, sizes = encoder.tables(text)
                rows.append((doc_id, text, encoder.ids_of(last, sizes), last.tobytes(), chars.tobytes(), sizes.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.string()] + [pa.binary()] * 4)],
                    [f.split()[0] for f in TABLE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, TABLE)


def apply_edits(tables: DataFrame, edits: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Rows of `tables` after edits (doc_id, at, removed, added), with `reused_bytes`.

    Each edit is applied by itself to the stored text of its document: it takes `removed`
    characters away from character `at` on and puts `added` there; at the text's end it appends.
    Places beyond the text are its end; null numbers are 0, a null `added` is empty. Documents
    without an edit are not returned. The result equals encoding the new text from scratch.
    """
    def each(batches):
        import pyarrow as pa

        encoder = _encoder(ranks, pattern)
        for batch in batches:
            rows = []
            for doc_id, text, last, chars, sizes, at, removed, added in zip(*(c.to_pylist() for c in batch.columns)):
                text, last, chars, sizes, reused = encoder.revised(
                    text, *(array("I", np.frombuffer(x, "<u4").tobytes()) for x in (last, chars, sizes)), at, removed, added)
                rows.append((doc_id, text, encoder.ids_of(last, sizes), last.tobytes(), chars.tobytes(),
                             sizes.tobytes(), reused))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        zip(*rows), [pa.int64(), pa.string()] + [pa.binary()] * 4 + [pa.int64()])],
                    [f.split()[0] for f in TABLE.split(", ")] + ["reused_bytes"])

    wanted = edits.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("at"),
        F.coalesce(F.col("removed").cast("long"), F.lit(0)).alias("removed"),
        F.coalesce("added", F.lit("")).alias("added"))
    return (
        tables.select("doc_id", "text", "last", "piece_chars", "piece_bytes").join(wanted, "doc_id")
        .mapInArrow(each, TABLE + ", reused_bytes long")
    )
