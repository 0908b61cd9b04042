"""Main text of web pages by two-pass block rules.

The page is cut into blocks at block-level tags.  First each block is classed on its own, by stop
words, length and links: a block of mostly link text is bad, a long one with many stop words good,
what is too short or has too few of them to tell is undecided.  Then undecided blocks inherit the
label of the nearest decided neighbours.  No tag makes a block good; what is marked as navigation,
header, footer, sidebar, notice, advert, form or reader comments is bad from the start, since long
comments read like an article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

#: Common function words of English, French, German and Spanish; other languages' come from the
#: page itself, by stop_words().
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i if in is it its not of on or she so that the
    their they this to was we were which who will with would you
    au aux avec ce dans de des du elle en est et il je la le les leur ne nous ou par pas pour qu que qui sa se ses son
    sur un une vous
    aber als am auf aus bei das dem den der die ein eine einen er es für ich im ist mit nach nicht sich sie sind um und
    von vor war wie wir zu zum zur über
    al como con del el era esta este fue los me más no para pero por sin su sus también una y ya""".split()
)
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What blocks stand in together.
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol section table td ul".split())
#: Their content is no text of the page.
HIDDEN = frozenset("button canvas datalist head iframe math menu nav noframes noscript object option script select style svg template textarea title footer form aside dialog".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adsense|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|related|replies|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:[\"'][^>]*)?)>", re.S)
_MARKS = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[^\W\d_]+")
#: Letters of the longest word that a page's own counts can make a stop word, and the share of its
#: blocks (and the least number of them) that such a word stands in.
BRIEF, OFTEN, LEAST = 5, 0.2, 3
#: Characters and stop-word shares of the rules, and the share of link text of a bad block.
SHORT, LONG, FEW, MANY, LINKED, SOME = 70, 200, 0.06, 0.15, 0.5, 0.2
GOOD, BAD, NEAR, AMBIGUOUS = "good", "bad", "near", "ambiguous"


@dataclass
class Block:
    """Text between two block-level tags; linked: characters in links; marked: stands in what is
    marked as no main text; path: the containers it stands in, from the outermost."""

    text: str
    linked: int
    heading: bool
    marked: bool
    path: tuple[int, ...]


def blocks(page: str) -> list[Block]:
    """The blocks that have text, in page order."""
    out: list[Block] = []
    parts: list[str] = []
    open_tags: list[tuple[str, bool]] = []  # name, hides its content
    path: list[int] = []
    state = {"linked": 0, "a": 0, "article": 0, "hidden": 0, "heading": 0, "container": 0}

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, state["linked"], state["heading"] > 0, state["hidden"] > 0, tuple(path)))
        parts.clear()
        state["linked"] = 0

    def add(raw):
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if state["a"]:
            state["linked"] += len(text.strip())

    def count(name, hides, by):
        for key, hit in (("a", name == "a"), ("article", name in ("article", "main")), ("heading", name in HEADINGS), ("hidden", hides)):
            if hit:
                state[key] += by
        if name in CONTAINERS and by > 0:
            state["container"] += 1
            path.append(state["container"])
        elif name in CONTAINERS:
            path.pop()

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            add(page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            if found[0].startswith("<![CDATA["):
                add(html.escape(found[0][9:].removesuffix("]]>")))
            continue
        if found[1]:
            if name in BLOCKS:
                flush()
            if any(t == name for t, _ in open_tags):
                while open_tags:
                    top, hides = open_tags.pop()
                    count(top, hides, -1)
                    if top == name:
                        break
            continue
        if name in BLOCKS:
            flush()
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or found[3].endswith("/"):
            continue
        if name == "p" and open_tags and open_tags[-1][0] == "p":
            count(*open_tags.pop(), -1)
        marks = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _MARKS.finditer(found[3])} if found[3] else {}
        hides = name in HIDDEN or name == "header" and not state["article"] or "hidden" in marks or marks.get("aria-hidden", "").lower() == "true" or marks.get("role", "").lower() in ROLES
        if name not in ("html", "body", "article", "main"):
            hides = hides or any(MARKED.search(marks.get(k, "")) for k in ("class", "id"))
        open_tags.append((name, hides))
        count(name, hides, 1)
    flush()
    return out


def stop_words(words: list[list[str]]) -> set[str]:
    """The stop words of a page: the known ones, and brief words that stand in many of its blocks,
    whatever the language."""
    held = Counter(w for own in words for w in set(own) if len(w) <= BRIEF)
    least = max(LEAST, OFTEN * sum(len(own) >= 5 for own in words))
    return STOP_WORDS | {w for w, n in held.items() if n >= least}


def label(block: Block, words: list[str], stop: set[str]) -> str:
    """The first pass: a block by itself.  Link text decides against a block, many stop words in a
    long block for it; few of them do not decide, unless there are links too."""
    linked = block.linked / len(block.text)
    if block.marked or linked > LINKED:
        return BAD
    if block.heading or len(block.text) < SHORT:
        return AMBIGUOUS
    share = sum(w in stop for w in words) / len(words) if words else 0.0
    if share >= MANY:
        return GOOD if len(block.text) >= LONG else NEAR
    return NEAR if share >= FEW else BAD if linked > SOME else AMBIGUOUS


def shared(a: tuple, b: tuple) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def settled(found: list[Block], labels: list[str]) -> list[bool]:
    """The second pass: whether each block is kept.  Undecided blocks get the label of the nearest
    decided neighbours: of that which shares more containers, then of that fewer blocks away; the
    ends of the page count as bad.  A tie goes for near blocks, against others."""
    if GOOD not in labels:
        labels = promoted(found, labels)
    n = len(labels)
    before, after = [(BAD, 0, n)] * n, [(BAD, 0, n)] * n
    for order, nearest in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = None
        for steps, i in enumerate(order):
            nearest[i] = (BAD, min(1, len(found[i].path)), -steps - 1) if last is None else (labels[last], shared(found[i].path, found[last].path), -abs(i - last))
            if labels[i] in (GOOD, BAD):
                last = i
    keep = []
    for block, own, (left, *near_left), (right, *near_right) in zip(found, labels, before, after, strict=True):
        if own in (GOOD, BAD):
            keep.append(own == GOOD)
        elif left == right:
            keep.append(left == GOOD)
        elif block.heading:
            keep.append(right == GOOD)  # a heading looks to what follows it
        elif near_left == near_right:
            keep.append(own == NEAR)
        else:
            keep.append((left if near_left > near_right else right) == GOOD)
    return keep


def promoted(found: list[Block], labels: list[str]) -> list[str]:
    """Labels of a page without a good block: near ones count as good; without these, of the runs of
    undecided blocks that with the most text does, from its first heading on if it has one."""
    if NEAR in labels:
        return [GOOD if x == NEAR else x for x in labels]
    runs, at = [], 0
    for bad, own in groupby(x == BAD for x in labels):
        size = len(list(own))
        if not bad:
            start = next((i for i in range(at, at + size) if found[i].heading), at)
            runs.append((sum(len(found[i].text) for i in range(start, at + size)), -start, at + size))
        at += size
    if not runs:
        return labels
    _, start, end = max(runs)
    return [GOOD if -start <= i < end else x for i, x in enumerate(labels)]


def main_text(page: str | None) -> str:
    """The main text of a page; empty if it has none, as for a null or empty page."""
    found = blocks(page or "")
    words = [_WORDS.findall(b.text.lower()) for b in found]
    stop = stop_words([w for w, b in zip(words, found, strict=True) if not b.marked and b.linked <= LINKED * len(b.text)])
    keep = settled(found, [label(b, w, stop) for b, w in zip(found, words, strict=True)])
    return " ".join(b.text for b, own in zip(found, keep, strict=True) if own)


def extracted(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text of the whole page.

    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by one space in page order.  Null pages count as empty and give an empty text; null and
    repeated ids and addresses give a row each."""

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    from pyspark.sql import functions as F

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html")).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
