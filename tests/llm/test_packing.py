"""Packing: ids of the tokenizer, gapless places, few sequences."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldtide.llm import packing
from fieldtide.llm.queries import tokenizer_path


def places(counts, capacity):
    """Every piece of a plan as (length, sequence, offset)."""
    out = []
    for length, first, pieces, per, sequence, offset in packing.plan(counts, capacity).tolist():
        out += [(length, sequence + k // per, offset + k % per * length) for k in range(pieces)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(0, 25), max_size=25))
def test_plan_is_gapless_and_within_a_third_rule(counts):
    got = places(counts, 30)
    assert Counter(n for n, _, _ in got) == Counter({k: c for k, c in counts.items() if c})
    by_sequence = {}
    for n, s, o in got:
        by_sequence.setdefault(s, []).append((o, n))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist()
        assert sum(n for _, n in own) <= 30 and sum(n > 10 for _, n in own) <= 2
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    # no two sequences that together fit in one: what best fit guarantees for all but one
    fill = sorted(sum(n for _, n in own) for own in by_sequence.values())
    assert sum(f <= 15 for f in fill) <= 1


def test_plan_ranks_are_used_once():
    rows = packing.plan({1500: 10**9, 2000: 3, 4096: 5, 17: 10**10, 1365: 7})
    for length in set(rows[:, 0].tolist()):
        own = rows[rows[:, 0] == length]
        assert (own[1:, 1] == own[:-1, 1] + own[:-1, 2]).all() and own[0, 1] == 0
    assert len(rows) < 1000


def texts():
    rng = random.Random(1)
    odd = [None, "", "  \n", "It's <|endoftext|> a<|startoftext|>b", "x y z\x1cq", "É é İ ß ﬁ",
           "don't " * 9000, "aé" * 20000, "😀 ok", "same", "same"]
    return odd + [" ".join(rng.choice(["the", "Quick", "brown-fox", "1234", "ünï"]) for _ in range(rng.randrange(3000))) for _ in range(40)]


def test_pack_equals_tokenizer(spark):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts())], "doc_id long, text string, part int").repartition(5)
    rows = packing.pack(docs, tokenizer_path()).collect()
    for i, text in enumerate(texts()):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        ids = [x for r in own for x in np.frombuffer(r.ids, dtype="<u4").tolist()]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert [r.length for r in own[:-1]] == [4096] * (len(own) - 1)
        assert [r.start for r in own] == [4096 * r.piece for r in own]
    whole = {}
    for r in rows:
        whole.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in whole.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0
        assert sum(n for _, n in own) <= 4096
    total = sum(r.length for r in rows)
    assert len(whole) <= -(-total // 4096) + 3


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (2, "c"), (3, None)], "doc_id long, text string")
    got = packing.sequences(packing.pack(docs, tokenizer_path())).collect()
    assert len(got) == 1 and sorted(got[0].doc_ids) == [1, 2, 2, 3] and len(got[0].ids) == 4 * 8


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["a b c", "x" * 5000])
def test_cache_starts_anew(monkeypatch, text):
    monkeypatch.setattr(packing, "CACHED_WORDS", 2)
    encoder = packing._Encoder(tokenizer_path())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    for many in ([text], [text + " " + text], [text, "", text]):
        got = [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.texts([t.encode() for t in many])]
        assert got == [want * t.count(text) for t in many]


def test_long_texts_are_sliced(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    docs = spark.createDataFrame([(1, "some words here " * 30), (2, "x")], "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in packing.pack(docs, tokenizer_path()).collect()}
    assert rows[1].length == 91 and rows[2].length == 2


def test_marks_that_compose_with_one_case():
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = ["H\u0331a The", "T\u0308 x", "J\u030c", "W\u030aORD Word", "h\u0331a", "H\u1dfa\u0331", "CAF\u00c9 Abc"]
    got = packing._Encoder(tokenizer_path()).texts([r.encode() for r in rows])
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [
        tokenizer.encode(r, add_special_tokens=False).ids for r in rows]
