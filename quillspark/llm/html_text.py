"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word count, link density and punctuation, by
those of the two blocks before and after it, by its tag, and by what the open containers (tag, class, id, role) say. A decision tree,
trained on ``TRAIN_PAGES`` small labelled pages made from a fixed seed, tells article from boilerplate. ``ANONYMOUS`` of those pages have plain
``div`` containers with random names, so that there only counts, density and neighbours tell. Article blocks are joined in page order.

Cases: null html is empty text; broken markup (unclosed tags, comments and scripts, stray ``<``) is read to the end; texts of any
length and depth are read whole, in linear time (sums of what containers say are kept with each open one, and a closing tag that is not
there is looked for once); repeated rows get equal results; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.trees import Tree, fit_tree

TRAIN_PAGES = 2000
#: Share of the training pages whose containers have random names.
ANONYMOUS = 0.4
DEPTH = 14
#: Least blocks of a leaf.
LEAF = 10.0

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"<>]*\"|'[^'<>]*'|[^<>\"'])*+[\"']?)(?:>|(?=<)|\Z)")
_NAMED = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template svg math head title select option textarea button iframe object canvas".split())
_RAW = frozenset("script style textarea title noscript template iframe".split())
_CONTAINERS = frozenset("nav header footer aside form article main section div ul ol table td body blockquote figure details dialog menu".split())
_NAME = re.compile(r"[a-z]+|[0-9]+")

_BAD = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget footer foot header masthead banner ad ads advert advertisement sponsor sponsored promo "
    "cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login search share sharing social related recommended toolbar pagination pager "
    "copyright legal disclaimer tags meta byline contentinfo complementary alert toast rail teaser outbrain taboola".split()
)
_COMMENT = frozenset("comment comments commentlist reply replies respond discussion disqus reviews thread".split())
_GOOD = frozenset("article content main post entry story body text page prose".split())


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    tag: str
    bad: int
    comment: int
    good: int
    article: int


def _hints(tag: str, attributes: str) -> tuple[int, int, int, int]:
    """What a container says: boilerplate, reader comments, content, article element."""
    names: set[str] = set()
    if "=" in attributes:
        for m in _NAMED.finditer(attributes):
            names.update(_NAME.findall((m[1] or m[2] or m[3] or "").lower()))
    bad = tag in ("nav", "footer", "aside", "form", "menu", "dialog", "header") or bool(names & _BAD)
    return int(bad), int(bool(names & _COMMENT)), int(bool(names & _GOOD) or tag == "main"), int(tag == "article")


class Open(NamedTuple):
    """An open container, with the sums of what it and those around it say; ``bad``: within the innermost article, if there is one."""

    name: str
    bad: int
    comment: int
    good: int
    article: int

    def inside(self, name: str, hints: tuple[int, int, int, int]) -> Open:
        bad, comment, good, article = hints
        return Open(name, 0 if article else self.bad + bad, self.comment + comment, self.good + good, self.article + article)


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, scripts, styles and the like left out."""
    out: list[Block] = []
    stack = [Open("", 0, 0, 0, 0)]
    places: dict[str, list[int]] = {}  # of each name, where it is open
    absent: set[str] = set()  # closing tags that do not come any more
    parts: list[str] = []
    linked_parts: list[str] = []
    anchors, tag, at, n = 0, "body", 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                linked = len("".join(linked_parts).split())
                out.append(Block(text, len(text.split()), linked, tag, *stack[-1][1:]))
        parts.clear()
        linked_parts.clear()

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if anchors:
                linked_parts.append(text)

    def closing_of(name: str, ending: str) -> re.Match | None:
        found = None if name in absent else re.compile(rf"(?i)</{name}{ending}").search(page, at)
        if found is None:
            absent.add(name)
        return found

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt)
        if not m:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name = bool(m[1]), m[2].lower()
        if name in _RAW and not closing:
            end = closing_of(name, r"\b")
            if end is None and name in ("script", "style", "textarea", "iframe", "noscript", "template"):
                at = n
            elif end is not None:
                close = page.find(">", end.end())
                at = n if close < 0 else close + 1
            continue
        if name == "a":
            anchors = max(0, anchors + (-1 if closing else 1))
        if name == "br":
            add(" ")
        if name in _INLINE:
            continue
        flush()
        anchors = 0
        if name in _SILENT and name not in _RAW and not closing and name != "head":
            end = closing_of(name, r"\s*>")
            if end is not None:
                at = end.end()
            continue
        if name in _CONTAINERS:
            if closing:
                if places.get(name):
                    first = places[name][-1]
                    while len(stack) > first:
                        places[stack.pop().name].pop()
            elif name not in _VOID:
                places.setdefault(name, []).append(len(stack))
                stack.append(stack[-1].inside(name, _hints(name, m[3])))
        tag = "body" if closing else name
    flush()
    return out


_TAGS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "td": 4, "div": 5, "blockquote": 6, "pre": 6, "dd": 6}


FEATURES = ("words", "link density", "letters a word", "tag", "boilerplate", "comment", "content", "article", "sentence ends a word")
#: Places of the features of neighbours.
NEAR = range(len(FEATURES), len(FEATURES) + 12)


def describe(found: list[Block]) -> np.ndarray:
    """Features of each block: its own (``FEATURES``), and word count, link density and container hints of two blocks before and after."""
    own = np.array([[b.words, b.linked / max(b.words, 1), len(b.text) / max(b.words, 1), _TAGS.get(b.tag, 0), b.bad, b.comment, b.good, b.article, sum(b.text.count(c) for c in ".!?") / max(b.words, 1)] for b in found], float).reshape(len(found), 9)
    none = np.zeros((2, 3))
    near = np.vstack([none, own[:, [0, 1, 4]], none])
    n = len(found)
    page = np.full((n, 2), [own[:, 7].any(), own[:, 6].any()]) if n else np.zeros((0, 2))
    return np.hstack([own, near[1 : n + 1], near[3 : n + 3], near[:n], near[4:], page])


_ROLE_TAGS = re.compile(r"<(/?)(?:nav|header|footer|aside|form|article|main|section)\b")
_NAMES = re.compile(r"(class|id)=\"[^\"]*\"")


def training_pages(pages: int = TRAIN_PAGES, seed: int = 3, anonymous: float = ANONYMOUS) -> list[tuple[str, list[bool]]]:
    """Pages of several layouts made from a seed, with a label (article or not) for each of their blocks."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    say = lambda lo, hi: " ".join(word() + pick(("", "", "", "", ",", ".")) for _ in range(rng.randint(lo, hi))).capitalize() + "."
    link = lambda lo=1, hi=2: f'<a href="/{word()}">{" ".join(word() for _ in range(rng.randint(lo, hi)))}</a>'
    maybe_link = lambda share: f" {link(1, 3)}" if rng.random() < share else ""

    def menu(n: int) -> str:
        return pick(("<nav><ul>{}</ul></nav>", '<ul class="menu">{}</ul>', '<div id="navbar"><ul>{}</ul></div>', "<ul>{}</ul>")).format("".join(f"<li>{link()}</li>" for _ in range(n)))

    def paragraph() -> str:
        lo, hi = pick(((1, 4), (5, 30), (20, 120), (20, 120)))
        return say(lo, hi) + (maybe_link(0.2) if hi > 30 else "")

    notices = (
        lambda: (f'<div class="{pick(("ad", "ads banner", "advert", "sponsored-box", "promo"))}">{say(4, 25)}{maybe_link(0.5)}</div>', 1),
        lambda: (f'<div class="{pick(("cookie-notice", "consent", "notice", "popup"))}"><p>{say(6, 30)}{maybe_link(0.7)}</p></div>', 1),
        lambda: (f'<aside>{pick(("<p>", "<div>"))}{say(5, 40)}{maybe_link(0.5)}</aside>', 1),
        lambda: (f'<div class="{pick(("sidebar", "side-bar", "widget", "related"))}"><p>{link(2, 7)}</p><p>{link(2, 7)} {word()}</p><p>{link(2, 7)}</p></div>', 3),
        lambda: (f'<div class="{pick(("sidebar", "side-bar", "widget", "related"))}"><p>{say(5, 40)}</p></div>', 1),
        lambda: (f"<form><p>{say(2, 12)}</p></form>", 1),
    )
    out = []
    for _ in range(pages):
        parts: list[tuple[str, list[bool]]] = []

        def off(markup: str, n: int = 1) -> None:
            parts.append((markup, [False] * n))  # noqa: B023

        if rng.random() < 0.8:
            k = rng.randint(3, 8)
            off(menu(k), k)
        if rng.random() < 0.4:
            off(pick((f"<header><h1>{say(1, 4)}</h1></header>", f'<div class="header">{say(1, 8)}</div>', f'<div id="masthead"><p>{say(2, 9)}</p></div>')))
        for _ in range(rng.randint(0, 2)):
            off(*pick(notices)())
        opening, closing = pick((("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main-text">', "</div>"), ('<div class="post-body">', "</div>"), ("<div>", "</div>"), ("", "")))
        inner: list[tuple[str, list[bool]]] = [(f"<h1>{say(2, 12)}</h1>", [True])] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.75:
                inner.append((f"<p>{paragraph()}</p>", [True]))
            elif kind < 0.85:
                inner.append((f"<p><b>{say(3, 20)}<br><p>{say(8, 60)}</p>", [True, True]))
            elif kind < 0.92:
                inner.append((f"<h2>{say(1, 6)}</h2>", [True]))
            else:
                inner.append((f"<ul><li>{say(3, 12)}</li><li>{say(3, 12)}</li></ul>", [True, True]))
            if rng.random() < 0.08:
                markup, n = pick(notices)()
                inner.append((markup, [False] * n))
        parts.append((opening + "".join(m for m, _ in inner) + closing, [x for _, f in inner for x in f]))
        for _ in range(rng.randint(0, 2)):
            off(*pick(notices)())
        if rng.random() < 0.35:
            n = rng.randint(1, 5)
            said = [say(3, 50) for _ in range(n)]
            off(pick((f'<section id="comments">{"".join(f"<p>{x}</p>" for x in said)}</section>', f'<ol class="commentlist">{"".join(f"<li>{x}</li>" for x in said)}</ol>', "".join(f'<div class="comment"><p>{x}</p></div>' for x in said))), n)
        if rng.random() < 0.8:
            tail = f"{say(3, 20)}" + "".join(f" {link()}" for _ in range(rng.randint(0, 4)))
            off(pick((f"<footer>&copy; {word()}.example.org &middot; {tail}</footer>", f'<div class="footer">{tail}</div>')))
        body = "".join(m for m, _ in parts)
        if rng.random() < anonymous:
            body = _NAMES.sub(lambda m: f'{m[1]}="{word()}"', _ROLE_TAGS.sub(r"<\1div", body))
        out.append((f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>", [x for _, f in parts for x in f]))
    return out


def train(pages: int = TRAIN_PAGES, depth: int = DEPTH, seed: int = 3) -> Tree:
    xs, ys = [], []
    for page, labels in training_pages(pages, seed):
        found = blocks(page)
        if len(found) == len(labels):
            xs.append(describe(found))
            ys += labels
    y = np.array(ys, float)
    return fit_tree(np.vstack(xs), 0.5 - y, np.ones(len(y)), depth, least=LEAF, ridge=0.1)


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree(describe(found)) > 0
    return " ".join(b.text for b, k in zip(found, keep) if k)


def extract_text(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``."""
    tree = tree or train()
    kind = dict(pages.dtypes)["page_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "", tree) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
