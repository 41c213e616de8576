"""The pipeline, stage by stage, against plain Python."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from fieldtide.llm import langid, quality
from fieldtide.llm.queries import tokenizer_path
from tests.llm.test_decontam import brute as brute_leaks
from tests.llm.test_neardup import brute_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        out.append(pipeline.stored(stage(spark, out[-1], SF), "t-" + name.replace(" ", "-")))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_order_and_columns(steps):
    assert [n for n, _ in pipeline.STAGES] == [
        "language ID", "quality classifier", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert all(ids(b) <= ids(a) for a, b in zip(steps, steps[1:]))


def test_language(steps):
    rows = steps[0].collect()
    judge = langid.Classifier(langid.fit(steps[0].where(langid.learned_rows())))
    assert ids(steps[1]) == {r.doc_id for r in rows if judge(r.text)[2]}
    assert len(ids(steps[1])) > 0.97 * len(rows)


def test_quality(spark, steps):
    rows = steps[1].collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(steps[1], labels)
    score, _ = model.scores(quality._views(*zip(*[(r.text, r.source, r.lang, r.n_chars) for r in rows])))
    assert ids(steps[2]) == {r.doc_id for r, s in zip(rows, score) if s >= model.threshold and r.text.strip()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    assert len(ids(steps[2]) & good) > 0.98 * len(ids(steps[1]) & good)


def test_near_copies(steps):
    groups = brute_groups([(r.doc_id, r.text) for r in steps[2].collect()])
    assert ids(steps[3]) == {i for i, root in groups.items() if i == root}
    assert steps[3].count() == len(ids(steps[3]))


def test_leaks(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in steps[3].collect()]
    assert ids(steps[4]) == {d for d, _ in rows} - {d for d, _ in brute_leaks(rows, items)}


def test_packing(steps):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    pieces, rows = steps[5].collect(), steps[4].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}
    for r in rows:
        want = np.array(tokenizer.encode(r.text, add_special_tokens=False).ids + [1], dtype="<u4")
        for p in (p for p in pieces if p.doc_id == r.doc_id):
            assert p.ids_crc32 == zlib.crc32(want[p.start:p.start + p.length].tobytes())
    assert sum(p.length for p in pieces) == sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)


def test_run_gives_the_last_stage(spark, steps):
    got = {(r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, SF).collect()}
    assert got == {(r.doc_id, r.piece, r.ids_crc32) for r in steps[5].collect()}


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_and_repeats(spark, tmp_path):
    """Rows with nulls in any column and repeated rows go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).selectExpr("cast(null as bigint) doc_id", "text", "cast(null as string) lang", "source", "n_chars")
    odd = odd.union(docs.limit(2)).union(docs.limit(2).selectExpr("doc_id + 90000", "cast(null as string)", "lang", "cast(null as string)", "cast(null as bigint)"))
    docs.union(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    places = [(r.doc_id, r.piece) for r in rows if r.doc_id is not None]
    assert len(places) == len(set(places)) and not any((d or 0) >= 90000 for d, _ in places)


def test_texts_go_to_python_in_small_batches(spark):
    """Also where a stage is run by itself and its result is written later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for given, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
        spark.conf.set(name, given)
        docs = spark.createDataFrame([(i, "a b c") for i in range(2500)], "doc_id long, text string").coalesce(1)
        pipeline.one_of_each_group(spark, docs.limit(0), SF)
        seen = docs.mapInArrow(lambda batches: (b.select(["doc_id"]).slice(0, 1) for b in batches), "doc_id long")
        assert spark.conf.get(name) == want and seen.count() == -(-2500 // int(want))
    spark.conf.unset(name)
