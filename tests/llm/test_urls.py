"""URL rules, the language models against a plain recursion, and odd URLs."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldtide.llm import urls

SCHEMA = "page_id long, url string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def plain_rule(host, path):
    best = None
    for h, p, says in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, says)
    return best or (None, None)


ODD = [None, "", "x", "://", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org", "http://example.org?/es/",
       "http://a.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/1", "http://org/es/", "ftp://x.COM/fr/",
       "http://x.com/de/1://y.org/", "http://É.com/de/", "http://x.net/fr/9", "a\nb://c.org/\nd?e", "http://x.com/FR/", "http://" + "a" * 70_000]


def test_rules(spark):
    rows = list(enumerate(ODD))
    got = {r.page_id: r for r in urls.ruled(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, url in rows:
        host, path = plain_parts(url)
        assert (got[i].host, got[i].path) == (host, path), url
        assert (got[i].rule, got[i].verdict) == plain_rule(host, path), url


def plain_score(train, url):
    """Log-likelihood by the recursive Witten-Bell formula over dictionaries."""
    grams, contexts, kinds = Counter(), Counter(), {}

    def symbols(u):
        return [2] * urls.ORDER + [48 if 48 <= b <= 57 else b for b in u.encode()] + [3]

    for u in train:
        s = symbols(u)
        for i in range(urls.ORDER, len(s)):
            for k in range(urls.ORDER + 1):
                c = tuple(s[i - k:i])
                grams[c, s[i]] += 1
                contexts[c] += 1
                kinds.setdefault(c, set()).add(s[i])

    def p(c, x):
        lower = p(c[1:], x) if c else 1 / urls.ALPHABET
        n = contexts[c]
        return (grams[c, x] + len(kinds[c]) * lower) / (n + len(kinds[c])) if n else lower

    s = symbols(url)
    return sum(math.log(p(tuple(s[i - urls.ORDER:i]), s[i])) for i in range(urls.ORDER, len(s))) / (len(s) - urls.ORDER)


@pytest.mark.parametrize("frequent", [1 << 19, 20, 0])
def test_models_equal_the_recursion(spark, monkeypatch, frequent):
    monkeypatch.setattr(urls, "CALIBRATED", 0.0)
    good = ["http://a.com/fr/1", "http://bb.com/fr/22", "http://c.org/x"]
    bad = ["http://a.com/de/1", "http://c.example.org/es/7"]
    ask = ["http://q.net/fr/3", "http://q.net/de/3", "", "é", "http://a.com/fr/1", "http://a.com/fr/1"] * 3
    rows = [(u, "allow") for u in good] + [(u, "block") for u in bad]
    asked = spark.createDataFrame([(u,) for u in ask + [None]], "url string").repartition(3)
    model = urls.fit(spark.createDataFrame(rows * 2, "url string, verdict string"), asked, frequent)
    assert len(model.grams) <= frequent and (model.least is None) == (frequent == 1 << 19)
    got = model.score(asked).collect()
    assert sorted(r.url or "" for r in got) == sorted(ask + [""])
    for r in got:
        url = r.url or ""
        assert r.url_score == pytest.approx(plain_score(good, url) - plain_score(bad, url))


def test_all_labelled_urls_are_counted(spark):
    good, bad = ([f"http://{w}{i % 7}.net/{w}/{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)] for w in ("ok", "no"))
    sides = [(u, "accepted") for u in good] + [(u, "rejected") for u in bad] + [(good[0], "asked")]
    counts = urls.gram_counts(spark.createDataFrame(sides, "url string, side string").repartition(5)).toPandas()
    assert counts.accepted.sum() == sum(len(u) + 1 for u in good)  # every character of every URL, and the end marks
    assert counts.rejected.sum() == sum(len(u) + 1 for u in bad) and counts.gram.is_unique
    end = int.from_bytes(b"t/ok/" + b"a", "big")
    assert counts.set_index("gram").accepted[end] == sum("t/ok/a" in u for u in good)


def test_threshold_tells_the_classes_apart(spark):
    rows = [(f"http://s{i}.net/{w}/{i % 10}{chr(97 + i % 26)}", v) for i in range(300) for w, v in (("fine", "allow"), ("poor", "block"))]
    ask = spark.createDataFrame([("http://q.net/fine/x",), ("http://q.net/poor/x",)], "url string")
    labelled = spark.createDataFrame(rows, "url string, verdict string")
    for frequent in (1 << 19, 10):
        model = urls.fit(labelled, ask, frequent)
        good, bad = (r.url_score for r in sorted(model.score(ask).collect()))
        assert bad < model.threshold <= good


def test_held_out_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    apart = F.pmod(F.xxhash64("page_id"), F.lit(3)) == 0
    known = urls.ruled(pages.select("page_id", "url")).where("verdict is not null")
    model = urls.fit(known.where(~apart), known.where(apart))
    held = model.score(known.where(apart)).toPandas()
    says = held.url_score >= model.threshold
    assert (says == (held.verdict == "allow")).mean() > 0.9


def test_rare_grams_change_no_verdict(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    whole, joined = (urls.judge(pages, frequent=n).toPandas().sort_values("page_id") for n in (1 << 19, 500))
    assert (whole.verdict.to_numpy() == joined.verdict.to_numpy()).all()
    assert whole.url_score.to_numpy() == pytest.approx(joined.url_score.to_numpy())


def test_every_row_is_judged(spark):
    rows = list(enumerate(ODD)) * 2
    docs = spark.createDataFrame([(i, u, "old") for i, u in rows], SCHEMA + ", host string")
    got = urls.judge(docs).collect()
    assert len(got) == len(rows) and {r.verdict for r in got} <= {"allow", "block"}
    by_id = {}
    for r in got:
        assert by_id.setdefault(r.page_id, r) == r
    assert urls.judge(docs.limit(0)).count() == 0
    plain = urls.judge(spark.createDataFrame([(1, "http://x.net/"), (2, None)], SCHEMA)).collect()
    assert [r.verdict for r in plain] == ["allow", "allow"]  # no labels: score 0 at threshold 0
