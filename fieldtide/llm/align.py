"""Alignment of the tokens of two tokenizers over one text.

Both tokenizers cut a text's bytes; where both end a token, a group ends, and within a group every
token of A is linked with every token of B. How many documents hold a pair of ids linked is
counted over the corpus.

Most groups are one token on either side with the same bytes. For those an array made once per
vocabulary tells the id of B that has the bytes of an id of A, and documents are counted in
vectors as long as A's vocabulary. Only other pairs go through a shuffle; the most frequent of
them are handed to the tasks like the vectors (a fixed number), so no key of the shuffle is hot.

A text is cut before spaces that follow no white space. Neither tokenizer joins over such a place
(checked for B's vocabulary when it is read), so each chunk is coded once and remembered.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import stored

BATCH = 1 << 20  # characters of text coded together
CACHED_CHUNKS = 400_000  # per Python worker, some 130 MB; the cache starts anew beyond it
LONG_CHUNK = 64  # characters; longer chunks are not kept
LARGE_GROUP = 4096  # links; larger groups are multiplied out by distinct ids
HELD_PAIRS = 2_000_000  # pairs of documents a task counts before it hands them on
HOT_PAIRS = 1 << 19  # most frequent pairs handed to the tasks, 9 MB; the rest are joined
CODED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
         "same binary, other binary")
_CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
_SPACE = "▁"


class Aligner:
    """Two tokenizers, the bytes of their ids, and for each id of A the id of B of the same bytes."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces):
            raise ValueError("B joins pieces over a space, so texts cannot be coded in chunks")
        self.bytes_a, self.bytes_b = self._bytes_of_a(), [self._piece(p) for p in pieces]
        self.length_a, self.length_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.same = self.identity()
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.space = [self.b.piece_to_id(_SPACE)]  # B codes nothing where a text's last space is its chunk
        self.says_a = [f"{i}{end}" for end in ",|" for i in range(len(self.bytes_a))]
        self.says_b = [f"{i}{end}" for end in ",;" for i in range(len(self.bytes_b))]

    def _bytes_of_a(self) -> list[bytes]:
        """Byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        value = {chr(b): b for b in plain}
        value |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in value.values())}
        out = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            out[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        return out

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(_SPACE, " ").encode()

    def identity(self) -> np.ndarray:
        """For each id of A the id of B with the same bytes, -1 if there is none.

        Of two such ids (a piece of one character and its byte) the piece is taken.
        """
        ids: dict[bytes, int] = {}
        for i, data in enumerate(self.bytes_b):
            if self.b.is_byte(i):
                ids.setdefault(data, i)
        ids |= {data: i for i, data in enumerate(self.bytes_b) if not (
            self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))}
        return np.array([ids.get(data, -1) for data in self.bytes_a], dtype=np.int64)

    def _learn(self, chunks: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids of A and B of chunks that are not remembered, coded together."""
        coded = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        found = {
            chunk: (array("I", a.ids).tobytes(), array("I", b or self.space).tobytes())
            for chunk, a, b in zip(chunks, coded, self.b.encode([c[1:] for c in chunks], num_threads=1))}
        if len(self.known) + len(found) > CACHED_CHUNKS:
            self.known.clear()
        self.known.update((c, ids) for c, ids in found.items() if len(c) <= LONG_CHUNK)
        return found

    def _ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of A and B of each text behind a space, chunk by chunk."""
        chunks = [_CHUNK.findall(" " + text) for text in texts]
        held = {c: self.known.get(c) for own in chunks for c in own}
        held |= self._learn([c for c, ids in held.items() if ids is None])
        each = [list(map(held.__getitem__, own)) for own in chunks]
        return tuple([np.frombuffer(b"".join([ids[side] for ids in own]), "<u4").astype(np.int64) for own in each]
                     for side in (0, 1))

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """Columns of CODED behind doc_id, of each text."""
        ids = zip(*self._ids([t or "" for t in texts]))
        fine, a, b = [], [], []
        for k, (text, (x, y)) in enumerate(zip(texts, ids)):
            data = (" " + text).encode("utf-8") if text else b""
            if data and (b"".join(map(self.bytes_a.__getitem__, x.tolist())) == data
                         == b"".join(map(self.bytes_b.__getitem__, y.tolist()))):
                fine.append(k)
                a.append(x)
                b.append(y)
        out = [(0, 0, 0, 0, "", b"", b"")] * len(texts)
        if fine:
            for k, row in zip(fine, self._aligned(a, b)):
                out[k] = row
        return iter(out)

    def _aligned(self, a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[tuple]:
        """All documents side by side: their bytes follow each other, so their groups do."""
        n_a, n_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        doc = np.repeat(np.arange(len(a)), n_a)
        a, b = np.concatenate(a), np.concatenate(b)
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
        last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        doc_of, links = doc[first_a], size_a * size_b
        said = self._said(a, b, last_a, last_b, group_a, group_b, size_a, size_b, doc_of, len(n_a))

        vocabulary = len(self.same)
        plain = (links == 1) & (self.same[a[first_a]] == b[first_b])
        own_doc, own_a, own_b, own_n = self._links(a, b, doc_of, size_a, size_b, first_a, first_b, links, plain)
        like = self.same[own_a] == own_b
        same = np.concatenate([doc_of[plain] * vocabulary + a[first_a[plain]], own_doc[like] * vocabulary + own_a[like]])
        same, same_n = _summed(same, np.concatenate([np.ones(int(plain.sum()), np.int64), own_n[like]]))
        width = len(self.bytes_b)
        other, other_n = _summed(
            (own_doc[~like] * vocabulary + own_a[~like]) * width + own_b[~like], own_n[~like])
        edges = np.arange(len(n_a) + 1)
        same_at, other_at = np.searchsorted(same, edges * vocabulary), np.searchsorted(other, edges * vocabulary * width)
        same = same % vocabulary
        other = (other // width % vocabulary << 32) | other % width
        n_groups, n_links = (np.bincount(doc_of, weights=w, minlength=len(n_a)).astype(np.int64) for w in (None, links))
        for k in range(len(n_a)):
            i, j, x, y = same_at[k], same_at[k + 1], other_at[k], other_at[k + 1]
            yield (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]), said[k],
                   np.concatenate([same[i:j], same_n[i:j]]).tobytes(), np.concatenate([other[x:y], other_n[x:y]]).tobytes())

    def _said(self, a, b, last_a, last_b, group_a, group_b, size_a, size_b, doc_of, n) -> list[str]:
        """Digest of each document's groups. Each token is its id and the sign behind it."""
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[group_a]] = a + last_a * len(self.bytes_a)
        codes[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = b + last_b * len(self.bytes_b) + len(self.says_a)
        ends = np.cumsum(np.bincount(doc_of, weights=size_a + size_b, minlength=n).astype(np.int64)).tolist()
        says, out, at = self.says_a + self.says_b, [], 0
        for end in ends:
            own = hashlib.sha256()
            for i in range(at, end, BATCH):
                text = "".join(map(says.__getitem__, codes[i:min(end, i + BATCH)].tolist()))
                own.update((text if i + BATCH < end else text[:-1]).encode("ascii"))
            out.append(own.hexdigest())
            at = end
        return out

    @staticmethod
    def _links(a, b, doc_of, size_a, size_b, first_a, first_b, links, plain):
        """Document, id of A, id of B and count of the links of all groups that are not plain."""
        small = np.flatnonzero(~plain & (links <= LARGE_GROUP))
        group = np.repeat(small, links[small])
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
        found = [(doc_of[group], a[first_a[group] + nth // size_b[group]], b[first_b[group] + nth % size_b[group]],
                  np.ones(len(group), np.int64))]
        for g in np.flatnonzero(links > LARGE_GROUP).tolist():
            x, times_x = np.unique(a[first_a[g]:first_a[g] + size_a[g]], return_counts=True)
            y, times_y = np.unique(b[first_b[g]:first_b[g] + size_b[g]], return_counts=True)
            found.append((np.full(len(x) * len(y), doc_of[g]), np.repeat(x, len(y)), np.tile(y, len(x)),
                          np.outer(times_x, times_y).ravel()))
        return tuple(map(np.concatenate, zip(*found)))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(data, dtype="<i8")
    return both[:len(both) // 2], both[len(both) // 2:]


def _aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker; it outlives the task."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("_fieldtide_align", ModuleType("_fieldtide_align")).__dict__.setdefault("aligners", {})
    if (path_a, path_b) not in kept:
        kept.clear()
        kept[path_a, path_b] = Aligner(path_a, path_b)
    return kept[path_a, path_b]


def code(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row of CODED per document: its counts, the digest of its groups and its linked pairs.

    same: ids of A linked with the id of B of the same bytes, and how often; other: all other
    pairs (id of A in the upper 32 bits) and how often.
    """
    def each(batches):
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = _aligner(path_a, path_b)
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary()]
        names = [f.split()[0] for f in CODED.split(", ")]

        def coded(rows):
            found = aligner.rows([t for _, t in rows])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*((i, *f) for (i, _), f in zip(rows, found))), kinds)], names)

        rows, held = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                rows.append((doc_id, text))
                held += len(text or "") + 100
                if held > BATCH:
                    yield coded(rows)
                    rows, held = [], 0
        if rows:
            yield coded(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(each, CODED)


def pair_counts(coded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, plain, docs, best): in how many documents each pair of ids is linked.

    plain: b has the bytes of a. best: no other id of B is linked with that id of A in more documents. Pairs of the same bytes
    are summed in one vector per task; the others are counted in the task before the shuffle.
    """
    def count(batches):
        import pyarrow as pa

        same = _aligner(path_a, path_b).same
        vector, held, size = np.zeros(len(same), dtype=np.int64), [], 0

        def rows(keys, docs, plain):
            return pa.RecordBatch.from_arrays(
                [pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(np.full(len(keys), plain)), pa.array(docs)],
                ["a", "b", "plain", "docs"])

        for batch in batches:
            for own, others in zip(batch.column(0), batch.column(1)):
                vector[_unpacked(own.as_py())[0]] += 1
                held.append(_unpacked(others.as_py())[0])
                size += len(held[-1])
                if size > HELD_PAIRS:
                    yield rows(*np.unique(np.concatenate(held), return_counts=True), False)
                    held, size = [], 0
        if size:
            yield rows(*np.unique(np.concatenate(held), return_counts=True), False)
        used = np.flatnonzero(vector)
        yield rows((used << 32) | same[used], vector[used], True)

    counts = coded.where("n_a > 0").select("same", "other").mapInArrow(
        count, "a long, b long, plain boolean, docs long")
    pairs = stored(counts.groupBy("a", "b", "plain").agg(F.sum("docs").alias("docs")), "pair-counts")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "plain", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, hot: int = HOT_PAIRS) -> DataFrame:
    """Counts of every document's links; `groups_sha256` stands for its groups.

    (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256). Texts that are null,
    empty or not given back by either tokenizer have no tokens: zeros and an empty digest. The
    strings of special tokens are plain text. Repeated rows are documents of their own and count
    as such; rows keep a null doc_id; further columns are ignored; no documents, no rows.
    A text is held in memory whole. `hot`: pairs handed to the tasks; it changes no result.
    """
    coded = stored(code(docs, path_a, path_b), "coded")
    counts = stored(pair_counts(coded, path_a, path_b), "pairs")
    spark = docs.sparkSession
    top = counts.where("plain").toPandas()  # one row per id of A at most
    often = stored(counts.where("not plain").orderBy(F.col("docs").desc(), "a", "b").limit(hot), "hot-pairs")
    table = often.toPandas()
    size = int(top["a"].max()) + 1 if len(top) else 0
    docs_of, best_of = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    docs_of[top["a"]], best_of[top["a"]] = top["docs"], top["best"]
    keys = ((table["a"].to_numpy(np.int64) << 32) | table["b"].to_numpy(np.int64)).astype(np.int64)
    order = np.argsort(keys)
    handed = spark.sparkContext.broadcast((
        docs_of, best_of, keys[order], table["docs"].to_numpy(np.int64)[order], table["best"].to_numpy(np.int64)[order]))

    def look_up(batches):
        import pyarrow as pa

        docs_of, best_of, keys, docs, best = handed.value
        for batch in batches:
            sums, bests, rest = [], [], []
            for own, others in zip(batch["same"], batch["other"]):
                a, times = _unpacked(own.as_py())
                total, won = int(docs_of[a] @ times), int(best_of[a] @ times)
                key, times = _unpacked(others.as_py())
                at = np.searchsorted(keys, key)
                there = at < len(keys)
                there[there] = keys[at[there]] == key[there]
                at = at[there]
                sums.append(total + int(docs[at] @ times[there]))
                bests.append(won + int(best[at] @ times[there]))
                rest.append([{"a": k >> 32, "b": k & 0xFFFFFFFF, "times": n}
                             for k, n in zip(key[~there].tolist(), times[~there].tolist())])
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
                 pa.array(bests, pa.int64()), pa.array(sums, pa.int64()),
                 pa.array(rest, pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "b", "times")])))],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum", "rest"])

    kept = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    looked = stored(coded.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        look_up, f"row long, {kept}, n_best long, count_sum long, rest array<struct<a long, b long, times long>>"), "looked")
    rare = counts.where("not plain").join(often.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "docs", "best")
    links = looked.where(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.*")
    more = links.join(rare, ["a", "b"]).groupBy("row").agg(
        F.sum(F.col("times") * F.col("docs")).alias("more_sum"),
        F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"))
    zero = F.lit(0)
    return looked.drop("rest").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")
