"""The index against scores of all documents computed one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldtide.llm import queries, search
from tests.oracle_check import compare

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, best=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, bag in bags:
            m = 100 - 25 + (25 * bag.total() * n_docs) // n_terms
            score = 0
            for t in terms(text):
                if tf := bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, doc_id))
        out += [(item_id, k, d, -s) for k, (s, d) in enumerate(sorted(found)[:best], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()))


def texts(rng, n):
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "ÄPFEL", "don't", "x1", "日本"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 5, 5, 5, 30, 200])))) for i in range(n)]


@pytest.mark.parametrize("block", [search.BLOCK_POSTINGS, 40])
def test_equals_brute_force(spark, block):
    rng = random.Random(block)
    docs = texts(rng, 400)
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties
    docs += [(2000, None), (2001, ""), (2002, " .,!"), (2003, "W1-w1_W2\x00w3")]
    items = texts(random.Random(5), 25) + [(90, None), (91, "!!"), (92, "nowhere")]
    index = search.build_index(
        spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id int, text string, m long, terms string"), block)
    found = search.search(index, spark.createDataFrame(
        [(i, t, 3) for i, t in items], "item_id long, text string, doc_id long"))
    assert rows(found) == sorted(brute(docs, items))
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_items_in_several_blocks(spark, monkeypatch):
    docs, items = texts(random.Random(1), 80), texts(random.Random(2), 30)
    index = search.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    given = spark.createDataFrame(items + items, "item_id long, text string")
    monkeypatch.setattr(search, "BLOCK_CHARS", 300)
    monkeypatch.setattr(search.item_blocks, "__defaults__", (300,))
    assert rows(search.search(index, given)) == sorted(brute(docs, items))


def test_strata_out_of_reach_are_not_visited():
    docs = texts(random.Random(3), 300)
    items = search.Items([(0, "w40 w41 w50")])
    bags = [Counter(search.terms_of(t)) for _, t in docs]
    strata = []
    for k in range(0, 300, 10):
        own = bags[k:k + 10]
        row = dict(zip([f.split()[0] for f in search.STRATUM.split(", ")], (75 + k, 0, *search._stratum(
            np.arange(k, k + 10), [b" ".join(b) for b in own], [np.array(list(b.values()), "<u4").tobytes() for b in own]))))
        strata.append(search.Stratum(row, items))
    ranking = search.Ranking(items, np.array([5000, 5000, 5000]), 3)
    ranking.see(strata)
    assert 0 < ranking.visited < len(strata)


def test_rows_without_ids_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "a")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "a"), (None, "b")], "item_id long, text string")
    index = search.build_index(docs)
    assert (index.n_docs, index.n_terms) == (3, 5)
    found = search.search(index, items).collect()
    assert sorted(r.doc_id for r in found if r.item_id is None) == [1, 1]
    empty = search.build_index(docs.where("false"))
    assert search.search(empty, items).count() == 0 == search.search(index, items.where("false")).count()


def test_query_equals_sql(spark, sf_dir, duck):
    assert compare(queries.QUERIES["op11_ranked_search"](spark, sf_dir), duck, queries.ORACLES["op11_ranked_search"]) is None
