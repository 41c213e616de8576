"""Prefix tables against the merges of a public library, exact round trips, and edits."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtide.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
ODD = ["", " ", "\n\n  x", "don't  'll\t\r\n ", "a" * 5000, "ab" * 3000, "<|endoftext|> </s>", "\x00\x1c\x85 　x",
       "日本語のテキスト" * 500, "é́", "👩‍👩‍👧 ok", "   " * 400, "0123456789" * 300, "!?" * 400]


def ids(data):
    return list(memoryview(data).cast("I"))


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_equals_library(text):
    text = text.encode("utf-8", "ignore").decode()
    data = ENCODER.ids(text)
    assert ids(data) == LIBRARY.encode_ordinary(text)
    assert ENCODER.decoded(data) == text.encode()


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_odd_texts(text):
    assert ids(ENCODER.ids(text)) == LIBRARY.encode_ordinary(text)


def test_long_text_goes_in_spans(monkeypatch):
    monkeypatch.setattr(bpe, "SPAN", 7)
    text = "The quick brown fox isn't here. " * 20
    data = ENCODER.ids(text)
    assert ids(data) == LIBRARY.encode_ordinary(text) and ENCODER.decoded(data) == text.encode()


def test_every_prefix_has_its_last_token():
    word = "unbelievableinternationalisation" * 3
    last = ENCODER.table(word.encode())
    for n in range(1, len(word) + 1):
        assert last[n - 1] == LIBRARY.encode_ordinary(word[:n])[-1]


def test_token_that_no_merge_makes():
    ranks = {bytes([i]): i for i in range(256)} | {b"abcd": 256, b"bc": 257}
    encoder = bpe.Encoder(ranks, r"[a-z]+|.")
    library = tiktoken.Encoding("odd", pat_str=r"[a-z]+|.", mergeable_ranks=ranks, special_tokens={})
    for text in ("abcd", "xabcd", "abcdabcd", "bcbc", "abcdx"):
        assert ids(encoder.ids(text)) == library.encode_ordinary(text)
    last, chars, sizes = encoder.tables("abcd")
    new = encoder.revised("abcd", last, chars, sizes, 4, 0, "x")
    assert ids(encoder.ids_of(new[1], new[3])) == library.encode_ordinary("abcdx")


@given(st.text("ab \n'sl1!é日", max_size=30), st.integers(0, 32), st.integers(0, 8), st.text("ab \n'sl1!é日", max_size=8))
@settings(max_examples=800, deadline=None)
def test_edit_equals_encoding_anew(text, at, removed, added):
    new, last, chars, sizes, _ = ENCODER.revised(text, *ENCODER.tables(text), at, removed, added)
    assert new == text[:at] + added + text[at + removed:]
    assert (last, chars, sizes) == ENCODER.tables(new)
    assert ids(ENCODER.ids_of(last, sizes)) == LIBRARY.encode_ordinary(new)


def test_edits_keep_what_is_far(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["river", "mountain", "isn't", "schön", "42", "日本"]) for _ in range(5000))
    docs = spark.createDataFrame([(1, text), (2, None), (3, "x" * 3000)], "doc_id long, text string")
    tables = bpe.encode_tables(docs, PATH, public_tokenizers.PATTERN)
    edits = spark.createDataFrame(
        [(1, 10_000, 3, "new words"), (1, len(text), 0, " more"), (2, 5, 5, "a"), (3, 3000, 0, "xyz"), (9, 0, 0, "")],
        "doc_id long, at int, removed int, added string")
    rows = bpe.apply_edits(tables, edits, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 4
    for r in rows:
        assert ids(r.ids) == LIBRARY.encode_ordinary(r.text)
        assert r.doc_id == 2 or r.reused_bytes > len(r.text.encode()) - 60


def test_rows_of_any_kind(spark):
    docs = spark.createDataFrame(
        [(1, t, b"x") for t in ODD] + [(None, "null id", None), (2, None, None)], "doc_id int, text string, ids binary")
    rows = bpe.encode(docs, PATH, public_tokenizers.PATTERN, decode=True).collect()
    assert sorted(r.decoded for r in rows) == sorted([t.encode() for t in ODD] + [b"null id", b""])
    again = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert sorted(r.data for r in again.collect()) == sorted(r.decoded for r in rows)
    assert bpe.encode(docs.where("false"), PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.QUERIES["op13_bpe"](spark, sf_dir)
    assert out.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    rows = out.collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = LIBRARY.encode_ordinary(texts[r.doc_id])
        data = b"".join(i.to_bytes(4, "little") for i in own)
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(data).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
