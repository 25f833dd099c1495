"""Main text by tag paths: parts that stay and go, long broken pages, ratios against a plain reading."""

import math
import re
import time

import pytest

from tapeloom.llm import html_text as H

P = "This paragraph has some words, and it goes on. It is long enough, surely, to be content."
KEPT = ['<section id="related-work"><p>{}</p></section>', '<h2 id="search">{}</h2>', '<div class="print">{}</div>', '<p class="share">{}</p>', '<section id="social-life"><p>{}</p></section>', '<div class="no-sidebar"><p>{}</p></div>']
GONE = ['<section class="comments"><p>{0}</p><p>{0}</p></section>', '<div class="ad-slot-1">{}</div>', '<div class="share-buttons"><a>{}</a></div>', '<div class="newsletter"><p>{}</p></div>', '<ul class="related-posts"><li><a>{}</a></li></ul>', "<aside>{}</aside>", "<form><p>{}</p></form>"]
PAGES = [f"<body><nav>n</nav><main><article><h1>T</h1><p>{P}</p>%s<p>{P}</p></article></main></body>", f"<body><div class='post'><h1>T</h1><p>{P}</p>%s<p>{P}</p></div></body>"]


@pytest.mark.parametrize("page", PAGES)
def test_names_lower_a_ratio_and_delete_nothing_by_themselves(page):
    part = "Part of it, with points. " + P
    for frag in KEPT:
        assert H.main_text(page % frag.format(part))[0] == f"T {P} {part} {P}", frag
    for frag in GONE:
        assert H.main_text(page % frag.format(part))[0] == f"T {P} {P}", frag


def test_form_around_the_page():
    assert H.main_text(f"<body><form><div id='menu'><a>a</a></div><div><h1>T</h1><p>{P}</p><p>{P}</p></div></form></body>")[0] == f"T {P} {P}"


def test_broken_and_deep_pages_end_soon():
    n = 50_000
    pages = ["<p>x, y.</p>" + "<a " * 7 * n, '<a x=">" ' * n, "<a x='" * n + ">", "<div>" * n + "deep, text." + "</div>" * n, "<div>t, x." * n, "<b><div>" + "<i>" * n + "</b>" * n, "<i>" * n + "<h2>x" * n, "<div>" * n + "</section>" * n, "</script " * n]
    began = time.time()
    for page in pages:
        H.main_text(page)
    assert time.time() - began < 60
    assert H.main_text(pages[3])[0] == "deep, text."
    assert H.main_text("<p>a &#" + "9" * 6000 + "; b &#" + "0" * 5000 + "65; c</p>")[0] == "a � b A c"


def _plain(page):
    """The chosen paths, read again with lists and strings."""
    name = {}
    for k, n in enumerate(page.nodes):
        name[k] = (*name[n.up], n.path) if k else ()
    paths = [name[k] for k, _, _ in page.blocks]
    fused = {}
    for p in set(paths):
        own = [(t, link) for q, (_, t, link) in zip(paths, page.blocks) if q == p]
        points = sum(len(re.findall(r"[.,;:!?…、。！，：；？]", t)) for t, _ in own)
        fused[p] = sum(max(0, len(t) - link) for t, link in own) / len(own) * (1 + math.log(1 + points / len(own)))
    seq = [fused[p] for p in paths]
    seq = [seq[0], *seq, seq[-1]]
    around = [(a + 2 * b + c) / 4 for a, b, c in zip(seq, seq[1:], seq[2:])]
    ratio = {p: math.sqrt(fused[p] * sum(a for a, q in zip(around, paths) if q == p) / paths.count(p)) for p in fused}
    factor = {p: page.nodes[k].factor for p, (k, _, _) in zip(paths, page.blocks)}
    sure = [(ratio[p], len(t)) for p, (_, t, _) in zip(paths, page.blocks) if factor[p] >= 1] or [(ratio[p], len(t)) for p, (_, t, _) in zip(paths, page.blocks)]
    cut = 0.35 * sum(r * n for r, n in sure) / sum(n for _, n in sure)
    return {p[-1] if p else 0 for p in ratio if ratio[p] * factor[p] >= cut}


def test_ratios_equal_a_plain_reading():
    part = "Part of it, with points. " + P
    for page in PAGES:
        for frag in KEPT + GONE:
            read = H.parse(page % frag.format(part))
            H.settle(read)
            assert H.content_paths(read) == _plain(read), frag
