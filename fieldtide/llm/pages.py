"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: the text between two borders of block elements. Each block has
features of its ancestors (tags, words of class, id and role) and of its text. A two-state chain
(main text or not), trained on labelled pages, labels the blocks of a page together by Viterbi.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that begin a new block, that have no content, and whose content is not text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li "
    "main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th "
    "thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object noembed noframes".split())
NEVER_EMPTY = frozenset(["script", "style"])  # a slash before `>` does not close these
CLOSES_P = BLOCKS - frozenset("button label option optgroup td th tr tbody thead tfoot caption body html head title legend".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
                "td": ("td", "th"), "th": ("td", "th")}
SECTIONS = frozenset("article main aside nav header footer section form dialog".split())
SCOPE = frozenset("ul ol dl table select article section div aside nav main body html".split())

# Words of class, id and role that tell what an element is for.
MEANINGS = {
    "comment": "comment comments commentlist reply replies respond disqus discussion feedback thread responses",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp outbrain taboola",
    "menu": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs pagination pager tabs toc skip topbar toolbar links",
    "side": "side sidebar aside related recommended recommendation recommendations widget widgets trending popular more complementary rail teaser",
    "notice": "cookie cookies consent notice notices gdpr privacy alert popup modal overlay newsletter subscribe subscription paywall toast disclaimer message",
    "share": "share sharing social follow tweet facebook twitter tags tag",
    "top": "header masthead logo brand head site banner hero",
    "bottom": "footer foot copyright legal contentinfo colophon credits imprint",
    "form": "form login signin signup search register contact poll survey input",
    "content": "content article post entry story main body text page single blog news prose maincontent",
    "byline": "byline author meta date time published info",
    "hidden": "hidden hide invisible print screenreader sr",
}
_MEANING = {word: group for group, words in MEANINGS.items() for word in words.split()}

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)"  # its attributes: see _Attributes
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_STOP = re.compile(r"""[>"']""")
_PAIRS = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Block:
    """Text of a leaf block with what stands around it."""

    text: str
    path: tuple[str, ...]  # features of the element and its ancestors
    link: int  # characters of the text that are in links


@dataclass(frozen=True)
class _Open:
    """An open element and what it and its ancestors say of the text inside; shared where it says nothing new."""

    tag: str
    leaf: str = "none"
    near: tuple[str, ...] = ()
    features: frozenset = frozenset()
    links: int = 0

    def inner(self, tag: str, names: tuple[str, ...]) -> _Open:
        new = {*names, f"in={tag}"} if tag in BLOCKS else set(names)
        return _Open(tag, tag if tag in BLOCKS else self.leaf,
                     (*self.near[-1:], tag) if tag in SECTIONS else self.near,
                     self.features if new <= self.features else self.features | new, self.links + (tag == "a"))

    def path(self) -> tuple[str, ...]:
        near = ">".join(self.near)
        return tuple(sorted({f"leaf={self.leaf}", f"near={near}", f"{self.leaf} near {near}"} | self.features))


class _Stack:
    """Open elements with the places of each tag, so no step walks over them."""

    def __init__(self):
        self.open, self.places = [_Open("")], {}

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(self.open[-1].inner(tag, names))

    def pop_to(self, names: tuple[str, ...], stop: frozenset) -> None:
        """Close the last element of one of the names, unless one of `stop` is open inside it."""
        last = lambda tags: max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        at = last(names)
        if at and at >= last(stop):
            for element in self.open[at:]:
                self.places[element.tag].pop()
            del self.open[at:]


class _Attributes:
    """Ends of tags in a page, in time linear in the page.

    A quoted value of any length may hold `>`. A tag with a quote that nothing closes, or without
    `>` behind its values, ends at its first `>`. Quotes from which no end was found are kept, so
    no later tag follows them again.
    """

    def __init__(self, page: str):
        self.page, self.open = page, set()

    def end(self, at: int) -> int:
        """Position behind the `>` of the tag whose attributes begin at `at`, or of the page's end."""
        seen, i = [], at
        while (stop := _STOP.search(self.page, i)) is not None and stop.start() not in self.open:
            if stop.group() == ">":
                return stop.end()
            seen.append(stop.start())
            i = self.page.find(stop.group(), stop.end()) + 1
            if not i:
                break
        self.open.update(seen)
        return self.page.find(">", at) + 1 or len(self.page)


def _meanings(attributes: str) -> tuple[str, ...]:
    if len(attributes) < 5:
        return ()
    found = set()
    for name, *values in _PAIRS.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id", "role"):
            found.update(f"is={_MEANING[w]}" for w in map(str.lower, _WORDS.findall(value)) if w in _MEANING)
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or (
                name == "style" and _NONE.search(value)):
            found.add("is=hidden")
    return tuple(sorted(found))


def blocks_of(page: str) -> list[Block]:
    """Leaf blocks of a page in order; white space inside a block is one space, blanks are left out."""
    out: list[Block] = []
    stack = _Stack()
    pieces: list[str] = []
    link = 0

    def flush() -> None:
        nonlocal pieces, link
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, stack.open[-1].path(), min(link, len(text))))
            pieces, link = [], 0

    def say(raw: str) -> None:
        nonlocal link
        text = entities.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if stack.open[-1].links:
            link += len(text)

    at, end, attributes = 0, len(page), _Attributes(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at:m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        at = attributes.end(m.end())
        if page[at - 1] != ">":
            continue
        tag, inside = tag.lower(), page[m.end():at]
        if m.group(1):
            if tag in BLOCKS:
                flush()
            stack.pop_to((tag,), frozenset())
            continue
        if tag in RAW and (tag in NEVER_EMPTY or not inside.endswith("/>")):
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P:
                stack.pop_to(("p",), SCOPE)
            if tag in SELF_CLOSING:
                stack.pop_to(SELF_CLOSING[tag], SCOPE)
        if tag not in VOID:
            stack.push(tag, _meanings(inside))
    flush()
    return out


def _bucket(n: float) -> int:
    return int(n).bit_length()


def text_features(block: Block) -> list[str]:
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    return [
        f"chars={_bucket(n)}", f"words={_bucket(words)}", f"link={min(4, 5 * block.link // n)}",
        f"ends={'.' if text[-1] in '.!?…»”\"' else 'x'}",
        f"stops={min(3, text.count('. ') + text.count('? ') + text.count('! '))}",
        "copyright" if "©" in text or "(c)" in text.lower()[:40] else "plain",
        f"bar={min(2, text.count('|') + text.count('»') + text.count('·'))}",
    ]


@dataclass
class Chain:
    """Weights of the field: one number per feature (main minus other) and the transitions."""

    weights: dict[str, float]
    transition: list[list[float]]
    start: list[float]
    seen: dict = field(default_factory=dict)

    def emission(self, block: Block) -> float:
        path = self.seen.get(block.path)
        if path is None:
            if len(self.seen) > 50_000:
                self.seen.clear()
            path = self.seen[block.path] = sum(self.weights.get(f, 0.0) for f in block.path) + self.weights["bias"]
        return path + sum([self.weights.get(f, 0.0) for f in text_features(block)])

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The most probable labels (Viterbi). Ties go to `not main`."""
        if not blocks:
            return []
        (oo, om), (mo, mm) = self.transition
        other, main = self.start[0], self.start[1] + self.emission(blocks[0])
        back = []
        for block in blocks[1:]:
            from_other, from_main = (main + mo > other + oo), (main + mm > other + om)
            back.append((from_other, from_main))
            e = self.emission(block)
            other, main = (main + mo if from_other else other + oo), (main + mm if from_main else other + om) + e
        state = main > other
        labels = [state]
        for from_other, from_main in reversed(back):
            state = from_main if state else from_other
            labels.append(state)
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        blocks = blocks_of(page) if page else []
        return "\n".join(b.text for b, is_main in zip(blocks, self.decode(blocks)) if is_main)


def train(labelled: list[tuple[list[Block], list[bool]]], steps: int = 160, rate: float = 0.12, ridge: float = 5e-5) -> Chain:
    """Maximum-likelihood weights by gradient steps (Adam) on the chains of all pages at once."""
    labelled = [(b, y) for b, y in labelled if b]
    names = {"bias": 0}
    rows = []
    for blocks, _ in labelled:
        rows.append([[0] + [names.setdefault(f, len(names)) for f in (*b.path, *text_features(b))] for b in blocks])
    pages, longest, n = len(rows), max(map(len, rows)), len(names)
    x = np.zeros((pages, longest, n), dtype=np.float32)
    y = np.zeros((pages, longest), dtype=int)
    mask = np.zeros((pages, longest), dtype=bool)
    for i, page in enumerate(rows):
        for t, found in enumerate(page):
            x[i, t, found] = 1
        y[i, :len(page)], mask[i, :len(page)] = labelled[i][1], True
    flat, total = x.reshape(-1, n), mask.sum()
    first, moves = np.bincount(y[:, 0], minlength=2), np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(moves, (y[:, :-1][both], y[:, 1:][both]), 1)
    want = flat.T @ (y * mask).ravel().astype(np.float32)
    theta = np.zeros(n + 6)
    m = v = np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, a, s = theta[:n], theta[n:n + 4].reshape(2, 2), theta[n + 4:]
        e = np.zeros((pages, longest, 2))
        e[:, :, 1] = (flat @ w.astype(np.float32)).reshape(pages, longest)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = s + e[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + a, axis=1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        # beyond a page's end alpha repeats its last value, so z is right for every length
        p = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + a + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        grad = np.concatenate([
            flat.T @ (p[:, :, 1] * mask).ravel().astype(np.float32) - want,
            (pair * both[:, :, None, None]).sum(axis=(0, 1)).ravel() - moves.ravel(),
            p[:, 0].sum(axis=0) - first]) / total + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w = theta[:n]
    return Chain({k: float(w[i]) for k, i in names.items()},
                 theta[n:n + 4].reshape(2, 2).tolist(), theta[n + 4:].tolist())


# --- labelled pages --------------------------------------------------------------------------

class _Maker:
    """Labelled pages by grammar: what sites put around an article, in many spellings."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: set[str] = set()
        alphabet = self.r.choice(["aeioustrnlmdpk", "aeiouéèàtrnlsqm", "aeiouäößchgnrt", "aeioñóíabcdlrs"])
        self.words = ["".join(self.r.choice(alphabet) for _ in range(self.r.randint(1, 9))) for _ in range(400)]

    def say(self, low: int, high: int, stop: str = ".") -> str:
        r, out = self.r, []
        for _ in range(r.randint(low, high)):
            words = [r.choice(self.words) for _ in range(r.randint(2, 16))]
            if r.random() < 0.04:  # noisy articles are articles too
                words = [w + r.choice(["%%%", "***", "&amp;&amp;", "###", " |"]) for w in words]
            out.append((" ".join(words)).capitalize() + stop)
        text = " ".join(out)
        return text.upper() if r.random() < 0.03 else text

    def odd(self) -> str:
        """An article's paragraph that does not read like one: lists, repetition, no full stop."""
        r = self.r
        words = [r.choice(self.words) for _ in range(r.randint(3, 60))]
        if r.random() < 0.3:
            words = [w for w in words[:8] for _ in range(r.randint(3, 25))]
        return r.choice([" | ", " | ", " ", ", ", "!! "]).join(words) + r.choice(["", "", " |", "&amp;", "."])

    def few(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(low, high)))

    def named(self, tag: str, group: str, inner: str, always: bool = False) -> str:
        r = self.r
        word = r.choice(MEANINGS[group].split()) if group else ""
        told = tag in ("nav", "header", "footer", "aside", "form", "dialog")  # the tag says it already
        if word and (r.random() < 0.4 if told else always or r.random() < 0.8):
            extra = r.choice(["", "-box", "_wrap", " block", "-1", " clearfix"])
            return f'<{tag} {r.choice(["class", "class", "id"])}="{word}{extra}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    def keep(self, text: str) -> str:
        self.main.add(" ".join(entities.unescape(text).split()))
        return text

    def links(self, n: int) -> str:
        items = [f'<a href="/{i}">{self.few(1, 4)}</a>' for i in range(n)]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(items)

    def paragraphs(self, n: int) -> str:
        r = self.r
        return "".join(f"<p>{self.say(1, 4)}" + ("</p>" if r.random() < 0.9 else "") for _ in range(n))

    def around(self) -> str:
        """Something that is not the article, from one of many kinds."""
        r = self.r
        kind = r.choice(["menu", "advert", "advert", "side", "notice", "share", "form", "comment", "crumbs"])
        div = r.choice(["div", "div", "section"])
        if kind == "menu":
            return self.named(r.choice(["nav", "nav", "div", "ul"]), "menu", self.links(r.randint(3, 9)))
        if kind == "advert":
            inner = r.choice([self.say(1, 2), f"<p>{self.say(1, 2)}</p>", f'<a href="#">{self.say(1, 1)}</a>', f"<h4>{self.few(1, 3)}</h4><p>{self.say(1, 2)}</p>"])
            return self.named(r.choice([div, "aside"]), "advert", inner, True)
        if kind == "side":
            inner = f"<h3>{self.few(1, 4)}</h3>" + r.choice([self.links(r.randint(2, 6)), self.paragraphs(r.randint(1, 2))])
            return self.named("aside", "side", inner) if r.random() < 0.6 else self.named(div, "side", inner, True)
        if kind == "notice":
            return self.named(r.choice([div, "dialog"]), "notice", r.choice([self.say(1, 3), self.paragraphs(r.randint(1, 2))]) + f"<button>{self.few(1, 2)}</button>", True)
        if kind == "share":
            return self.named(div, "share", self.links(r.randint(2, 5)), True)
        if kind == "form":
            return self.named("form", "form", f"<label>{self.few(1, 3)}</label><input name=q>" + r.choice(["", f"<p>{self.say(1, 1)}</p>", f"<select><option>{self.few(1, 2)}<option>{self.few(1, 2)}</select>"]) + f"<button>{self.few(1, 2)}</button>")
        if kind == "comment":
            return self.comments()
        return self.named(div, "menu", " &gt; ".join(f'<a href="#">{self.few(1, 2)}</a>' for _ in range(3)), True)

    def comments(self) -> str:
        r = self.r
        one = lambda: self.named(r.choice(["div", "li", "article"]), r.choice(["comment", "comment", ""]), f"<b>{self.few(1, 2)}</b>" + self.paragraphs(r.randint(1, 2)))
        return self.named(r.choice(["section", "div", "ol", "aside"]), "comment", f"<h3>{self.few(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 5))), True)

    def article(self) -> str:
        r, parts = self.r, []
        title = self.keep(r.choice([self.say(1, 1), self.few(3, 9), self.say(1, 1, "")])[:r.choice([60, 200])].strip())
        parts.append(r.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<header><h1>{title}</h1></header>"]))
        if r.random() < 0.15:
            parts.append(self.named("div", "byline", self.few(2, 5), True))
        for _ in range(r.choice([1, 2, 4, 7, 12])):
            x = r.random()
            if x < 0.72:
                p = self.keep(r.choice([self.odd] * 2 + [lambda: self.few(1, 3).capitalize()] + [lambda: self.say(1, r.choice([1, 3, 8]))] * 7)())
                parts.append(r.choice([f"<p>{p}</p>"] * 6 + [f"<p>{p}", f"<p><b>{p}<br>", f"<div>{p}</div>", f"<p><a href='#'>{p}</a></p>"]))
            elif x < 0.79:
                parts.append(f"<h2>{self.keep(self.few(2, 7))}</h2>")
            elif x < 0.85:
                parts.append("<ul>" + "".join(f"<li>{self.keep(self.say(1, 1))}</li>" for _ in range(r.randint(2, 4))) + "</ul>")
            elif x < 0.89:
                parts.append(f"<blockquote><p>{self.keep(self.say(1, 2))}</p></blockquote>")
            elif x < 0.91:
                parts.append("<table><tr>" + "".join(f"<td>{self.keep(self.few(2, 5))}</td>" for _ in range(3)) + "</tr></table>")
            elif x < 0.93:
                parts.append(f"<pre>{self.keep(self.few(4, 12))}</pre>")
            else:
                parts.append(self.around() if r.random() < 0.7 else self.named("div", "advert", self.say(1, 2), True))
        inner = "".join(parts)
        return r.choice([
            f"<article>{inner}</article>", f"<article>{inner}</article>", f"<main>{inner}</main>",
            f"<main><article>{inner}</article></main>", self.named("div", "content", inner, True),
            self.named("section", "content", inner, True), self.named("article", "content", inner), f"<div>{inner}</div>"])

    def page(self) -> tuple[str, set[str]]:
        r = self.r
        top = "" if r.random() < 0.3 else self.named(r.choice(["header", "header", "div"]), "top", r.choice([self.few(1, 4), f"<h1>{self.few(1, 3)}</h1>", f"<h2>{self.few(1, 3)}</h2><p>{self.say(1, 1)}</p>"]) + (self.links(3) if r.random() < 0.4 else ""), True)
        before = "".join(self.around() for _ in range(r.randint(0, 3)))
        after = "".join(self.around() for _ in range(r.randint(0, 3))) + (self.comments() if r.random() < 0.3 else "")
        foot = r.choice([f"&copy; {self.few(1, 2)} &middot; {self.say(1, 1)}", self.say(1, 2), self.paragraphs(1) + self.links(3), f"<p>&copy; {self.few(1, 3)}</p>"])
        bottom = "" if r.random() < 0.15 else self.named(r.choice(["footer", "footer", "div"]), "bottom", foot, True)
        body = r.choice([self.article(), self.article()]) if r.random() > 0.04 else ""
        return (f"<html><head><title>{self.say(1, 1)}</title></head><body>{top}{before}{body}{after}{bottom}</body></html>",
                self.main if body else set())


def labelled_pages(n: int, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """n pages made by the grammar above, cut into blocks, with the label of each block."""
    out = []
    for i in range(n):
        page, main = _Maker(seed * 1_000_003 + i).page()
        blocks = blocks_of(page)
        out.append((blocks, [b.text in main for b in blocks]))
    return out


TRAINING_PAGES = 400  # a documented bound: the labelled pages are made, not taken from the corpus


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> Chain:
    return train(labelled_pages(pages, seed))


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """pages with `text`: the main text of html, blocks joined by line feeds.

    Null, empty or textless html: empty text. A page without any tag has no block that its
    ancestors or neighbours mark as an article; the field decides by its text alone. Time is linear
    in the page, also for elements nested to any depth. Rows are independent, so repeated rows and hosts of
    any size do no harm; an existing column `text` is replaced.
    """
    model = chain or trained()

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.extract(h) for h in batch], dtype=object)

    main_text = F.pandas_udf(each, "string")
    return pages.withColumn("text", main_text("html"))
