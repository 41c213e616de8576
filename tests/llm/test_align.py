"""The alignment against whole texts coded by the libraries and all links counted one by one."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldtide.llm import align, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CODER_A = tokenizers.Tokenizer.from_file(A)
CODER_A.encode_special_tokens = True
CODER_B = sentencepiece.SentencePieceProcessor(model_file=B)
ALIGNER = align.Aligner(A, B)
ODD = ["", None, " ", "\n\n  x", "a\x00b", "a▁b c", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café  über\t\n x ",
       "日本語のテキスト ok", "a" * 3000, "   " * 50, "don't stop", "x" * 200 + " y", "\x1c \x1d a", "　ok ok",
       "the cat the cat the cat", "é́ ﬁ", "x  ", "\r\n \r\n"]


def unit(i):
    if CODER_B.is_byte(i):
        return bytes([int(CODER_B.id_to_piece(i)[3:5], 16)])
    return CODER_B.id_to_piece(i).replace("▁", " ").encode()


def groups(text):
    """Groups of the whole text, without chunks or caches."""
    if not text:
        return []
    a, b = CODER_A.encode(" " + text, add_special_tokens=False).ids, CODER_B.encode(text)
    whole = (" " + text).encode()
    parts_a, parts_b = [ALIGNER.bytes_a[i] for i in a], [unit(i) for i in b]
    if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
        return []
    out, i, j, x, y = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y and i < len(a):
            out[-1][0].append(a[i])
            x += len(parts_a[i])
            i += 1
        else:
            out[-1][1].append(b[j])
            y += len(parts_b[j])
            j += 1
        if x == y:
            out.append(([], []))
    return out[:-1]


def said(found):
    text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in found)
    return hashlib.sha256(text.encode()).hexdigest() if found else ""


def brute(texts):
    """Rows without ids, from all links of all texts."""
    every = [groups(t) for t in texts]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in every]
    docs = Counter(p for links in linked for p in links)
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return [(sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), links.total(),
             sum(n for p, n in links.items() if docs[p] == most[p[0]]),
             sum(n * docs[p] for p, n in links.items()), said(g)) for g, links in zip(every, linked)]


def digits(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


def test_bytes_of_a_are_those_of_the_library():
    import base64
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, lines)}
    assert all(ALIGNER.bytes_a[i] == data for i, data in ranks.items())


@given(st.text(max_size=80) | st.text("ab \n\t'. é日▁<s>", max_size=40))
@settings(max_examples=400, deadline=None)
def test_equals_groups_of_one_text(text):
    text = text.encode("utf-8", "ignore").decode()
    found, row = groups(text), next(ALIGNER.rows([text]))
    assert row[4] == said(found) and row[2] == len(found)


def test_cache_that_starts_anew(monkeypatch):
    texts = ["naïve café  über\t\n x und so weiter " * 9 + "x" * 90, " ", "a  b ", "so weiter x"]
    whole = [(said(groups(t)), len(groups(t))) for t in texts]
    monkeypatch.setattr(align, "CACHED_CHUNKS", 3)
    monkeypatch.setattr(align, "LONG_CHUNK", 6)
    monkeypatch.setattr(align, "BATCH", 5)
    fresh = align.Aligner(A, B)
    for _ in range(2):
        assert [(r[4], r[2]) for t in texts for r in fresh.rows([t])] == whole
    assert [(r[4], r[2]) for r in fresh.rows(texts)] == whole


def test_large_groups_are_multiplied_out(monkeypatch):
    text = "xqzjk" * 40 + " 日本語のテキスト" * 3 + " naïve"
    before = list(ALIGNER.rows([text, "a cat"]))
    monkeypatch.setattr(align, "LARGE_GROUP", 1)
    assert list(ALIGNER.rows([text, "a cat"])) == before


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 3, 0])
def test_equals_brute_force(spark, hot):
    texts = ODD + ["the cat sat", "the cat sat", "Über den Fluß"] * 3
    docs = spark.createDataFrame([(i, t, 5, i) for i, t in enumerate(texts)], "doc_id int, text string, n_a long, row int")
    rows = sorted(align.align(docs, A, B, hot).collect(), key=lambda r: r.doc_id)
    assert digits(rows) == brute(texts)


def test_rows_without_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a cat"), (1, "a cat"), (1, "a cat")], "doc_id long, text string")
    rows = align.align(docs, A, B).collect()
    assert sorted(digits(rows)) == sorted(brute(["a cat"] * 3)) and sum(r.doc_id is None for r in rows) == 1
    assert align.align(docs.where("false"), A, B).count() == 0


def test_held_pairs_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(align, "HELD_PAIRS", 2)
    texts = ["Über den Fluß", "naïve café", "Über naïve"] * 4
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert digits(sorted(align.align(docs, A, B).collect(), key=lambda r: r.doc_id)) == brute(texts)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    out = queries.QUERIES["op12_token_alignment"](spark, sf_dir)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
                          ] + [("groups_sha256", "string")]
    rows = sorted(out.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    assert digits(rows) == brute([d.text for d in docs])
