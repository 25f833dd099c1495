"""Main text of web pages by tag-path ratios.

Text is gathered in blocks, each under its path of block elements from the root.
Per path, text length and punctuation are summed and divided by the number of
blocks; the ratios are smoothed over the page's order, fused and cut at a
threshold.  The paths above it vote for the content node, whose blocks are the
text.  Class words such as ``comments`` lower the ratio of their paths, which then
stay only if they still reach the threshold.  Every step is linear in the page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import batches, small_batches, texts_of

#: Elements of the HTML standard by their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr nobr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp"}
SKIPPED = set("head nav footer aside form button select menu dialog svg math canvas object video audio map datalist fieldset".split()) | RAW
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names in class, id and role of parts beside the article; a name counts when its words are these and ``AROUND``.
BESIDE = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar aside rail widget cookie cookies consent gdpr notice notices alert toast "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc footer header masthead topbar toolbar comments comment disqus replies reply respond "
    "recommended recommendations newsletter subscribe subscription signup login popup modal overlay dialog complementary contentinfo hidden".split()
)
#: Names that an article can use for its own parts too; they lower a ratio less.
DOUBTFUL = set("share sharing social related search print skip".split())
AROUND = set(
    "box block wrapper wrap container content list section area bar inner outer item items unit slot zone top bottom left right main site page post posts article articles entry "
    "link links button buttons icon icons text title form panel group row column col user reader body thread feed".split()
)
MAIN = {"article", "main"}
_FACTOR, _DOUBT = 0.03, 0.5  # what these names leave of a ratio

# The body of a tag runs to the first ">" outside a quoted value; nothing in it is tried twice.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TAG = re.compile(r"</?[a-zA-Z]")
_LONG_NUMBER = re.compile(r"&#([0-9]{20,});?")
_WORDS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…、。！，：；？]")
_LOW = 0.35  # share of the mean fused ratio that a content path reaches
_MOST = 0.5  # share of the text from which a form holds the page


@dataclass(slots=True)
class Node:
    name: str
    path: int  # number of the tag path
    up: int
    beside: bool  # never content: its tag, or hidden
    main: bool  # an article or main, or inside one
    factor: float = 1.0  # what its names leave of the ratio


@dataclass
class Page:
    """Block elements of a page, and its blocks of text with the element that each stands in."""

    nodes: list[Node] = field(default_factory=lambda: [Node("", 0, -1, False, False)])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # element, text, characters inside links
    paths: dict[tuple, int] = field(default_factory=lambda: {(): 0})

    def open(self, up: int, name: str, mark: str, beside: bool, main: bool, factor: float) -> int:
        path = self.paths.setdefault((self.nodes[up].path, name, mark, beside, factor), len(self.paths))
        self.nodes.append(Node(name, path, up, beside, main, factor))
        return len(self.nodes) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per element the values of itself and all inside it."""
        out = values.tolist()
        for k in range(len(out) - 1, 0, -1):  # elements stand behind those that hold them
            out[self.nodes[k].up] += out[k]
        return np.array(out)

    def inside(self, top: int) -> list[bool]:
        out = [top == 0]
        for k, n in enumerate(self.nodes[1:], 1):
            out.append(k == top or out[n.up])
        return out


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)} if text.strip() else {}


def _is_beside(name: str, attributes: dict[str, str], in_main: bool) -> bool:
    if name in SKIPPED or name == "header" and not in_main:
        return True
    return bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or _HIDDEN.search(attributes.get("style", "")) is not None)


def _factor(name: str, attributes: dict[str, str], in_main: bool) -> float:
    """What the names of an element leave of its ratio."""
    if not attributes or name in ("body", "html", *MAIN) or name in HEADINGS:
        return 1.0
    least = 1.0
    for k in ("class", "role") if name in INLINE else ("class", "id", "role"):
        for token in attributes.get(k, "").lower().split():
            words = {w for w in _WORDS.findall(token) if not w.isdigit()}
            if not words or not words <= BESIDE | DOUBTFUL | AROUND or in_main and words & BESIDE == {"header"}:
                continue
            least = min(least, _FACTOR if words & BESIDE else _DOUBT if words & DOUBTFUL and name not in INLINE else 1.0)
    return least


def parse(source: str) -> Page:
    """Read tags in order; unclosed and unmatched ones are tolerated, a broken tail is kept as text."""
    page = Page()
    stack: list[tuple[str, int]] = [("", 0)]  # open elements: name and the block element they are or stand in
    places: defaultdict[str, list[int]] = defaultdict(list)  # where each name is open in the stack
    solid: list[int] = []  # where elements other than inline ones are open
    walls: list[int] = []  # of these, the ones that are no headings or paragraphs
    buffer: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        if buffer:
            raw = _LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:9] or '0'};", "".join(buffer))
            text = " ".join(html.unescape(raw).split())
            if text:
                page.blocks.append((stack[-1][1], text, linked))
            buffer.clear()
        linked = 0

    def push(name: str, node: int):
        at = len(stack)
        stack.append((name, node))
        places[name].append(at)
        if name not in INLINE:
            solid.append(at)
            if name != "p" and name not in HEADINGS:
                walls.append(at)

    def pop_to(at: int):
        while len(stack) > at:
            places[stack.pop()[0]].pop()
        for kept in (solid, walls):
            while kept and kept[-1] >= at:
                kept.pop()

    tokens = _TOKEN.finditer(source)
    while (m := next(tokens, None)) is not None:
        name = m[2]
        if not name:
            token = m[0]
            if token == "<" and _TAG.match(source, m.start()):  # a tag without end: so are all behind it
                buffer.append(source[m.start() :])
                break
            if token[0] != "<" or token == "<":
                buffer.append(token)
                if places["a"]:
                    linked += len(token)
            continue
        name = name.lower()
        if name == "br":
            buffer.append(" ")
            continue
        if m[1]:
            at = places[name][-1] if places[name] else 0
            if not at or name in INLINE and solid and solid[-1] > at:
                continue  # an inline end tag does not close the blocks inside it
            if name not in INLINE:
                flush()
            pop_to(at)
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        up = stack[-1][1]
        attributes = _attributes(m[3])
        if name in INLINE:
            hidden, factor = _is_beside(name, attributes, True), _factor(name, attributes, True)
            if hidden or factor < 1:  # an inline part beside the text is a block of its own
                flush()
                up = page.open(up, name, "", hidden, page.nodes[up].main, factor)
            push(name, up)
            continue
        flush()
        closes = SIBLINGS.get(name, {"p"})
        at = max((places[c][-1] for c in closes if places[c]), default=0)
        stop = walls[-1] if walls else 0
        if at and stop <= at and (name in SIBLINGS or not places["p"] or places["p"][-1] == at):
            pop_to(at)
        up = stack[-1][1]
        in_main = page.nodes[up].main
        mark = ".".join(_WORDS.findall(attributes.get("class", "").lower()))
        node = page.open(up, name, mark, _is_beside(name, attributes, in_main), in_main or name in MAIN, _factor(name, attributes, in_main))
        if m[3].endswith("/") and name in ("svg", "math"):
            continue
        push(name, node)
        if name in RAW:
            pop_to(len(stack) - 1)
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, m.end())  # its content is no markup
            tokens = _TOKEN.finditer(source, end.end() if end else len(source))
    flush()
    return page


def settle(page: Page) -> None:
    """Hand ``beside`` and ``factor`` down, and drop blocks beside the article.

    A form that holds at least half of the text is the page.  Names do not count on
    an element with nine tenths of the text, or with half of it and an article inside.
    """
    out = [False]
    for n in page.nodes[1:]:
        out.append(out[n.up] or n.beside and n.name != "form")
    size = np.zeros(len(page.nodes))
    for k, text, _ in page.blocks:
        size[k] += 0 if out[k] else len(text)
    size = page.sums(size)
    mains = page.sums(np.array([n.name in MAIN for n in page.nodes], np.int64))
    for k, n in enumerate(page.nodes[1:], 1):
        if n.name == "form" and size[k] >= _MOST * size[0]:
            n.beside = False
        if n.factor < 1 and (size[k] >= 0.9 * size[0] or mains[k] and size[k] >= _MOST * size[0]):
            n.factor = 1.0
        up = page.nodes[n.up]
        n.beside, n.factor = n.beside or up.beside, min(n.factor, up.factor)
    page.blocks = [b for b in page.blocks if not page.nodes[b[0]].beside]


def content_paths(page: Page) -> set[int]:
    """Paths whose fused, smoothed ratio of text and punctuation to blocks passes the threshold."""
    order: dict[int, int] = {}
    own = [page.nodes[k].path for k, _, _ in page.blocks]
    place = np.array([order.setdefault(p, len(order)) for p in own], np.int64)
    if not len(place):
        return set()
    count = np.bincount(place)
    length = np.bincount(place, [max(0, len(t) - link) for _, t, link in page.blocks]) / count
    points = np.bincount(place, [len(_PUNCTUATION.findall(t)) for _, t, _ in page.blocks]) / count
    fused = length * (1 + np.log1p(points))
    around = np.convolve(np.pad(fused[place], 1, mode="edge"), [0.25, 0.5, 0.25], "valid")  # over the page's order
    smooth = np.bincount(place, around) / count
    ratio = np.sqrt(fused * smooth)
    factor = np.bincount(place, [page.nodes[k].factor for k, _, _ in page.blocks]) / count
    weight = np.bincount(place, [len(t) for _, t, _ in page.blocks])
    if (factor >= 1).any():
        weight = weight * (factor >= 1)  # parts that their names doubt do not set the threshold
    cut = _LOW * float((ratio * weight).sum() / max(weight.sum(), 1))
    return {p for p, k in order.items() if ratio[k] * factor[k] >= cut}


def main_text(source: str | None) -> tuple[str, list[str]]:
    """The text and its blocks."""
    if not source:
        return "", []
    page = parse(source)
    settle(page)
    nodes = page.nodes
    chosen = content_paths(page)
    votes = np.zeros(len(nodes))
    for k, text, link in page.blocks:
        if nodes[k].path in chosen:
            votes[k] += max(1, len(text) - link)
    votes = page.sums(votes)
    total = votes[0]
    if not total:
        return "", []
    mains = [k for k, n in enumerate(nodes) if n.name in MAIN and not n.beside and not nodes[n.up].main]
    best = max(mains, key=lambda k: (votes[k], -k), default=0)
    if best and votes[best] >= 0.3 * total:
        within = page.inside(best)
        inner = [k for k, n in enumerate(nodes) if n.name == "article" and nodes[best].name == "main" and within[k] and k != best]
        dense = max(inner, key=lambda k: (votes[k], -k), default=0)
        top, named = (dense if dense and votes[dense] >= 0.7 * votes[best] else best), True
    else:
        # the deepest element with most of the votes; under it, paths below the threshold that are links go
        top, named = max((k for k in range(len(nodes)) if votes[k] >= 0.8 * total), default=0), False
        while top and (nodes[top].name in HEADINGS or nodes[top].name in ("p", "li", "td", "th", "blockquote", "pre", "dd", "dt")):
            top = nodes[top].up
    within = page.inside(top)
    blocks = [t for k, t, link in page.blocks if within[k] and (nodes[k].path in chosen or nodes[k].factor >= 1 and (named or link <= 0.5 * len(t)))]
    return " ".join(blocks), blocks


def extract(pages: DataFrame) -> DataFrame:
    """Per page ``page_id``, ``url``, ``text``, ``n_chars`` (its code points) and ``blocks``.

    A null or empty html, or one without content, gives an empty text.  The whole
    html is read.  One row per input row; other columns are not read; no shuffle.
    """
    small_batches(pages.sparkSession)
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("blocks", T.ArrayType(T.StringType()))])

    def run(parts):
        for b in batches(parts):
            found = [main_text(None if t is None else t.decode("utf-8", "replace")) for t in texts_of(b.column("html"))]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.string()))], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
