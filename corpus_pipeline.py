"""Documents to training sequences: the stages and their run over a corpus.

Every stage works on all that its predecessor kept. All but the last return the columns of
`documents`; the last returns the place of every piece of a document in the sequences.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from fieldtide.llm import decontam, langid, neardup, quality, queries
from fieldtide.llm.common import read_table, small_batches, stored


def _in_small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_in_small_batches
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compression classifier, fitted on the labelled part of docs; texts it rejects go."""
    model = langid.fit(docs.where(langid.learned_rows()))
    return langid.classify(docs, model).where("accepted").select(*docs.columns)


@_in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Co-trained classifier, fitted on docs and `labels`; documents below its threshold go."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("kept").select(*docs.columns)


@_in_small_batches
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash links, and five-word similarity of 0.8 and more beyond them: of each group the
    document with the smallest id stays."""
    return neardup.drop_similar(docs)


@_in_small_batches
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain an item of `benchmark` go."""
    return decontam.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


@_in_small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 ids."""
    return queries.packed_digest(docs)


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]
ORACLE_SQL = None  # models, hashes and a tokenizer that SQL cannot express; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
