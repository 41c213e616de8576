"""HTML extraction: blocks, the chain against enumeration, and held-out pages."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtide.llm import pages


def texts(html):
    return [b.text for b in pages.blocks_of(html)]


@pytest.mark.parametrize("html, want", [
    ("", []), ("plain  text\n here", ["plain text here"]), ("a<b>b</b>c<br>d", ["abc d"]),
    ("<p>one<p>two</p>three", ["one", "two", "three"]), ("<p>x &amp; y&nbsp;z &#233; &eacute &am</p>", ["x & y z é é &am"]),
    ('<script>var t="</p>";if(a<b){}</script><p>t</p><style>p{}</style>', ["t"]), ("<script>never closed <p>x", []),
    ("<!-- a <p> b --><p>c<!-- open", ["c"]), ('<p title="a>b">c</p>', ["c"]), ("<p title='a>c</p>d", ["c", "d"]),
    ("a < b and <3 c", ["a < b and <3 c"]), ("<P>A</P><DIV>B</DIV>", ["A", "B"]), ("<p>a</p", ["a"]), ("<p>x<p class=\"q", ["x"]),
    ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<![CDATA[ x ]]><?php y ?><!doctype html>z", ["z"]), ("</div></p>a", ["a"]), ("<p>   </p>b", ["b"]),
])
def test_blocks(html, want):
    assert texts(html) == want


def test_ancestors_and_links():
    block = pages.blocks_of('<div class="page-Footer"><ul><li><a href=x>abcd</a> e</ul></div>')[0]
    assert {"in=div", "in=ul", "in=li", "leaf=li", "is=bottom"} <= set(block.path) and block.link == 4


def test_decode_equals_enumeration():
    rng = random.Random(2)
    block = [pages.Block(f"text {i}.", (f"in=p{i % 4}",), 0) for i in range(7)]
    for _ in range(20):
        names = {f for b in block for f in (*b.path, *pages.text_features(b))} | {"bias"}
        chain = pages.Chain({n: rng.gauss(0, 1) for n in sorted(names)}, [[rng.gauss(0, 1) for _ in range(2)] for _ in range(2)],
                            [rng.gauss(0, 1), rng.gauss(0, 1)])

        def score(y):
            return chain.start[y[0]] + sum(chain.emission(b) * v for b, v in zip(block, y)) + sum(
                chain.transition[a][b] for a, b in zip(y, y[1:]))

        assert chain.decode(block) == list(map(bool, max(itertools.product((0, 1), repeat=7), key=score)))


def test_training_raises_the_likelihood():
    data = pages.labelled_pages(60, 5)
    chain = pages.train(data, steps=60)

    def log_p(chain, blocks, y):
        def score(z):
            return chain.start[z[0]] + sum(chain.emission(b) * v for b, v in zip(blocks, z)) + sum(
                chain.transition[a][b] for a, b in zip(z, z[1:]))
        return score(y) - math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=len(y))))

    short = [(b, list(map(int, y))) for b, y in data if 1 < len(b) <= 11]
    flat = pages.Chain(dict.fromkeys(chain.weights, 0.0), [[0, 0], [0, 0]], [0, 0])
    assert short and all(log_p(chain, *s) > log_p(flat, *s) for s in short)


@pytest.fixture(scope="module")
def chain():
    return pages.trained()


def test_held_out_pages(chain):
    right = total = kept = main = 0
    for blocks, labels in pages.labelled_pages(120, seed=99):
        got = chain.decode(blocks)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.96, right / total


def test_given_pages(spark, chain):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in rows:
        body = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        assert chain.extract(r.html) == "\n".join(texts(body))


def test_odd_rows(spark, chain):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p></p>"), (4, "u", "<article><h1>A title</h1><p>" + "Long text here. " * 100_000 + "</p></article>")]
    docs = spark.createDataFrame([(*r, "old") for r in rows + rows[:1]], "page_id long, url string, html string, text string")
    got = pages.extract(docs, chain).select("page_id", "text", F.length("text").alias("n")).collect()
    assert [r.text for r in got[:3]] == ["", "", ""] and got[3].n == 8 + 1600_000 - 1 and len(got) == 5
    assert pages.extract(docs.limit(0), chain).count() == 0
    assert np.isfinite(list(chain.weights.values())).all()


@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_attributes(quote):
    value = "x" * 5000 + ", then <b>leak</b>"
    block, last = pages.blocks_of(f"<div data-x={quote}{value}{quote} class={quote}ad{quote}>ad</div>text")
    assert block.text == "ad" and "is=advert" in block.path and last.text == "text"
    inside = pages.blocks_of('<p data-json="' + "y" * 5000 + " hidden class='ad' display:none" + '">kept</p>')[0]
    assert inside.text == "kept" and not [f for f in inside.path if f.startswith("is=")]


def test_open_quotes_are_followed_once():
    assert texts('<p a=">">b</p>' + '<a ">"' * 60_000 + "'")[0] == "b"


@pytest.mark.parametrize("html", [
    "<div>" * 20_000 + "t", "<b>" * 20_000 + "t", "<p><table>" + "<b>x<div>" * 10_000, "<a>" * 20_000 + "t</x>" * 20_000,
    "<div class=footer><ul><li>" * 7_000, "<li>" * 20_000 + "</ul>" * 20_000, "<section><i>" * 10_000 + "t" + "</i>" * 10_000])
def test_deep_nesting_takes_linear_time(html):
    import time

    start = time.perf_counter()
    pages.blocks_of(html)
    assert time.perf_counter() - start < 2


def plain_blocks(html):
    """Path features by walking over the open elements, as they are defined."""
    out = []
    for block in pages.blocks_of(html):
        leaf = [f for f in block.path if f.startswith("leaf=")]
        out.append((block.text, leaf, [f for f in block.path if f.startswith("near=")]))
    return out


def test_paths_of_nested_sections():
    found = plain_blocks("<main><article><section><p>a</p></section><p>b</p></article></main><p>c")
    assert found == [("a", ["leaf=p"], ["near=article>section"]), ("b", ["leaf=p"], ["near=main>article"]), ("c", ["leaf=p"], ["near="])]
    block = pages.blocks_of('<div class="sidebar"><b><a href=x>l</a> t</b></div><p>u')
    assert "is=side" in block[0].path and block[0].link == 1 and "is=side" not in block[1].path and block[1].link == 0


def test_hand_written_page_of_another_make(spark):
    """No grammar made this page: the article stays, what stands around it goes."""
    said = "The council voted on Tuesday to reopen the old harbour bridge after three years of repairs. "
    html = f"""<!DOCTYPE html><html><head><title>Bridge</title><script>let a = "<p>x</p>";</script></head><body>
    <div id="masthead"><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></div>
    <div class="post-content"><h1>Harbour bridge reopens</h1><p>{said}</p><p>{said * 2}</p>
    <p>Engineers said the steel deck had been replaced in full.&nbsp;Traffic starts at noon.</p></div>
    <div class="related-links"><ul><li><a href="/1">Ten best walks</a></li><li><a href="/2">Weather today</a></li></ul></div>
    <div id="comments"><p class="comment">First! Great news.</p></div>
    <div class="cookie-notice">We use cookies. <button>Accept</button></div>
    <div id="footer">Copyright 2024 <a href="/imprint">Imprint</a></div></body></html>"""
    text = pages.extract(spark.createDataFrame([(1, html)], "page_id long, html string")).first().text
    assert said.strip() in text and "Traffic starts at noon." in text
    assert not any(x in text for x in ("cookies", "Ten best", "First!", "Imprint", "Sport", "let a"))
