"""Language identification by compression.

The letters of a text are encoded with a zstandard dictionary of raw text for each language; the
language that leaves the fewest bytes is chosen. Texts are encoded in blocks, each from the
dictionary anew, so that a long text cannot become its own dictionary. Short texts, where a byte
decides, are encoded with more dictionaries at a second level, and the sizes are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtide.llm.common import unit_hash

UNKNOWN = "und"
DICTIONARY_BYTES = 100_000  # of raw text per language
SLICE = 2_000  # characters taken of one training document
BLOCK = 4_096  # bytes encoded from one state of the dictionary
LEVEL = 9
SHORT, SHORT_LEVEL, SHORT_PARTS = 512, 3, 3  # bytes below which parts of the dictionary count too
MARGIN = 0.003  # below it the decision is rejected
_OTHER = re.compile(r"[\W\d_]+")
RESULT = "lang_pred string, score double, accepted boolean"


def learned_rows() -> Column:
    """Rows that may teach: a language is given and crc32 of the id mod 4 is not 2."""
    return F.col("lang").isNotNull() & ~held_out()


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw dictionary of each language from labelled (doc_id, text, lang).

    A bounded sample: of each language about `size` bytes are used, in slices of SLICE characters
    from documents that a hash of their text picks. Languages are as many as the labels have. A
    language without any letter in its texts is not learned.
    """
    letters = labelled.where(F.col("text").rlike(r"\p{L}"))
    want = 4 * size // SLICE
    counts = {r["lang"]: r["n"] for r in letters.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, want / n))) for k, n in sorted(counts.items())])
    start = F.floor(unit_hash(F.lit("start"), "text") * F.greatest(F.char_length("text") - SLICE, F.lit(0)))
    rows = (
        letters.where(unit_hash(F.lit("pick"), "text") < share)
        .select("lang", F.xxhash64("text").alias("h"), F.col("text").substr((start + 1).cast("int"), F.lit(SLICE)).alias("t"))
        .dropDuplicates(["lang", "h"]).collect()
    )
    model = {}
    for lang in counts:
        parts = [_plain(r["t"]) for r in sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["h"], r["t"]))]
        data = b"".join(p for p in parts if p.strip())[:size]
        if data:
            model[lang] = data
    return model


def _plain(text: str) -> bytes:
    """The letters in lower case, all else as one space."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


class Classifier:
    """Compressors for every language. Ties go to the language that comes first by name."""

    def __init__(self, model: dict[str, bytes], margin: float = MARGIN):
        self.names, self.margin = sorted(model), margin
        self.coders = [self._coder(model[n], LEVEL) for n in self.names]
        cut = {n: -(-len(model[n]) // SHORT_PARTS) for n in self.names}
        self.short = [[self._coder(model[n][i:i + cut[n]], SHORT_LEVEL) for i in range(0, len(model[n]), cut[n])]
                      for n in self.names]

    @staticmethod
    def _coder(data: bytes, level: int):
        import zstandard as z

        book = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=level)
        return z.ZstdCompressor(
            level=level, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not self.names or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, False
        if len(self.names) == 1:
            return self.names[0], 1.0, True
        data = _plain(text)
        blocks = [data[i:i + BLOCK] for i in range(0, len(data), BLOCK)]
        size = np.array([sum([len(c.compress(b)) for b in blocks]) for c in self.coders], dtype=float)
        if len(data) < SHORT:
            size += [sum([len(c.compress(data)) for c in own]) / len(own) for own in self.short]
        best = int(size.argmin())
        second = np.partition(size, 1)[1]
        score = float((second - size[best]) / second)
        return self.names[best], score, score >= self.margin


def classify(docs: DataFrame, model: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """docs with lang_pred, score (how much smaller than the second, 0 to 1) and accepted.

    Only the whole text decides. Null text or no letter in it: `und`, 0.0, not accepted. A
    margin below `margin` gives the language but not accepted. The model is of bounded size.
    """
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        judge = Classifier(model, margin)
        for batch in texts:
            yield pd.DataFrame([judge(t) for t in batch], columns=["lang_pred", "score", "accepted"])

    judged = F.pandas_udf(each, RESULT)
    return docs.withColumn("__judged", judged("text")).select(
        *[c for c in docs.columns if c not in ("lang_pred", "score", "accepted")],
        "__judged.lang_pred", "__judged.score", "__judged.accepted")
