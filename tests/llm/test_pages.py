"""Main text of pages that sites really serve: odd markup, compound names, broken tags, long pages."""

import random
import time

import pytest

from tests.llm.page_templates import template_pages
from trackloom.llm import html_extract

TEXT = "The ferry leaves the old harbour at nine and reaches the island before noon, weather permitting."
MORE = "Tickets are sold on board, and bicycles travel free on weekdays in spring."


@pytest.fixture(scope="module")
def weights():
    return html_extract.fit(html_extract.labelled_pages())


KEPT = {
    "overflow": f'<div style="overflow: hidden"><p>{TEXT}</p></div>',
    "has-sidebar": f'<div class="content has-sidebar"><p>{TEXT}</p></div>',
    "no-comments": f'<div class="post no-comments"><p>{TEXT}</p></div>',
    "compound": f'<div class="search-result-page"><p>{TEXT}</p></div>',
    "compound above": f'<div class="search-result-page"><article><p>{TEXT}</p></article></div>',
    "no end of head": f"<html><head><title>x</title><body><p>{TEXT}</p>",
    "no body": f"<html><head><title>x</title><style>p {{}}</style><p>{TEXT}</p>",
    "svg": f'<p>{TEXT}</p><svg width="3" />',
    "svg before": f'<svg width="3" /><p>{TEXT}</p>',
    "svg with text": f"<svg><path/><text>icon</text></svg><p>{TEXT}</p>",
    "iframe": f'<iframe src="/x"/><p>{TEXT}</p>',
    "iframe with end": f'<iframe src="/x">none</iframe><p>{TEXT}</p>',
    "words in a title": f'<div class="post" title="class menu sidebar"><p>{TEXT}</p></div>',
    "sign in a value": f'<p title="a > b" data-x=\'<p>\'>{TEXT}</p>',
    "no quote": f"<p class=post id=x>{TEXT}",
    "comment": f"<!-- <p>no</p> --><p>{TEXT}</p><!-- <p>no",
    "script": f"<script>var t = \"</p><p>no\";</script><p>{TEXT}</p><script>no",
    "hidden": f'<p hidden>no</p><div style="display:none">no</div><div aria-hidden="true"><p>no</p></div><p>{TEXT}</p>',
    "unclosed": f"<div><p><b><i>{TEXT}",
    "stray ends": f"</div></b></table><p>{TEXT}</b></span></p></article></div>",
    "doctype": f"<!DOCTYPE html><?xml version=1?><p>{TEXT}</p>",
    "upper case": f"<SCRIPT>no</SCRIPT><P>{TEXT}</P>",
    "plain": TEXT,
}


@pytest.mark.parametrize("name", KEPT)
def test_text_of_odd_pages(weights, name):
    assert html_extract.extract(KEPT[name], weights) == TEXT


NO_PARAGRAPHS = {
    "divs": f"<body><div>{TEXT}</div><div>{MORE}</div></body>",
    "spans": f"<div><span>{TEXT}</span></div><div><span>{MORE}</span></div>",
    "nested": f"<div><div><div>{TEXT}</div><div>{MORE}</div></div></div>",
    "foreign name": f'<div class="xyz">{TEXT}</div><div class="xyz">{MORE}</div>',
    "cells": f"<table><tr><td>{TEXT}</td></tr><tr><td>{MORE}</td></tr></table>",
    "sections": f"<section>{TEXT}</section><section>{MORE}</section>",
    "line ends": f"<body>{TEXT}<br><br>{MORE}</body>",
    "form": f'<body><form id="f"><div id="main"><p>{TEXT}</p><p>{MORE}</p></div></form></body>',
    "form with menu": f'<form method="post" action="./default.aspx" id="aspnetForm"><div class="menu"><a href=/>Home</a><a href=/n>News</a></div><div>{TEXT}</div><div>{MORE}</div><div id="footer">Copyright 2004</div></form>',
    "table layout": f"<table><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a></td></tr><tr><td>{TEXT} {MORE}</td><td></td></tr><tr><td>Copyright 1999</td></tr></table>",
    "related": f'<article><p>{TEXT}</p><div class="related-links"><h3>Related posts</h3><ul><li><a href=/a>One post here</a><li><a href=/b>Another post</a></ul></div><p>{MORE}</p></article>',
    "newsletter": f'<main><p>{TEXT}</p><section class="newsletter-signup"><p>Stay informed.</p><p>Get the latest news in your inbox every week.</p></section><p>{MORE}</p></main>',
}


@pytest.mark.parametrize("name", NO_PARAGRAPHS)
def test_text_outside_paragraphs(weights, name):
    assert html_extract.extract(NO_PARAGRAPHS[name], weights) == f"{TEXT} {MORE}"


def test_short_items_stay_in_their_list(weights):
    page = f"<article><p>{TEXT}</p><ul><li>Bring your own lunch and drinks</li><li>One</li><li>Keep your ticket until you leave</li></ul></article>"
    assert html_extract.extract(page, weights) == f"{TEXT} Bring your own lunch and drinks One Keep your ticket until you leave"


def test_a_sentence_is_never_lost(weights):
    """Whatever plain elements it stands in; menus alone have no text."""
    rng = random.Random(3)
    for _ in range(300):
        page = TEXT
        for _ in range(rng.randint(0, 5)):
            tag = rng.choice("div span section td p form center main article body li dd pre b".split())
            page = f"<{tag}{rng.choice(['', ' class=qv', ' id=c12'])}>{page}</{tag}>"
        assert html_extract.extract(page, weights) == TEXT, page
    assert html_extract.extract("<ul><li><a href=/a>Home</a><li><a href=/b>Sport</a></ul>", weights) == ""


def test_the_run_equals_all_runs(weights):
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rng.randint(0, 9))]
        every = [(sum(scores[a:b]), -a, -b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        best = max((e[0] for e in every), default=0)
        want = (0, 0) if best <= 0 else min(((a, b) for s, _, _, a, b in every if s == best), key=lambda r: (r[1], -r[0]))
        got = html_extract.best_run(scores)
        assert sum(scores[slice(*got)]) == max(best, 0) and (best <= 0 or got[1] == want[1])
    for page in template_pages(30, 9):
        read = html_extract.Page(page, weights)
        each = [html_extract.word_score(f, weights) for _, _, f in read.blocks]
        scores = [weights.get(f"<{t}", weights["<"]) if isinstance(t, str) else each[t] * read.blocks[t][1] for t in read.tokens]
        sums = [0.0]
        for s in scores:
            sums.append(sums[-1] + s)
        best = max(sums[b] - sums[a] for a in range(len(sums)) for b in range(a, len(sums)))
        start, end = html_extract.best_run(scores)
        assert abs(sums[end] - sums[start] - best) < 1e-9
        kept = html_extract.chosen(read, each, weights)
        inside = [t for t in read.tokens[start:end] if not isinstance(t, str)]
        assert {t for t in inside if each[t] > 0} <= set(kept) <= set(inside) and kept == sorted(kept)


def test_what_surrounds_an_article(weights):
    page = f"""<body><div class="masthead">Harbour News</div><ul class="main-nav"><li><a href=/a>Home</a><li><a href=/b>Sport</a></ul><div class="layout with-sidebar"><main>
    <article class="story"><header><h1>Ferry times</h1></header><p>{TEXT}</p><div class="ad-slot">Buy a boat now!</div><p>{MORE} <a href=/m>More</a></p><table><tr><td>Nine<td>Noon</table></article>
    <section id="comment-list"><article class="comment"><p>I took this ferry last year and it was late, as always, what a shame.</p></article></section></main>
    <div class="sidebar"><h3>Most read</h3><ul><li><a href=/c>One</a><li><a href=/d>Two</a></ul></div></div><div class="cookie-notice">We use cookies to measure visits. <button>Fine</button></div>
    <form action=/s>Search the site <input name=q></form><footer>&copy; Harbour News, all rights reserved.</footer>"""
    assert html_extract.extract(page, weights) == f"Ferry times {TEXT} {MORE} More Nine Noon"


BROKEN = {
    "open tags": "<a " * 300_000,
    "unclosed": "<i>" * 150_000 + "</b>" * 150_000,
    "links": "<a>" * 50_000 + "<div>" * 50_000 + "</a>" * 50_000,
    "quotes": "<a href=\"" * 100_000,
    "comments": "<!--" * 250_000,
    "blocks": "<div>x" * 100_000,
    "names": "".join(f"<div class=c{i}>x" for i in range(50_000)),
    "cells": "<td>" * 100_000 + "</div>" * 100_000 + "</table>" * 50_000,
    "raw": "<iframe>" * 100_000 + "<textarea>" * 50_000,
    "signs": "<" * 1_000_000,
    "entities": "&" * 1_000_000,
}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_pages_of_a_megabyte_take_linear_time(weights, name):
    page = BROKEN[name]
    begun = time.perf_counter()
    html_extract.extract(page, weights)
    assert time.perf_counter() - begun < 6, len(page)


def test_ties_take_the_first_run():
    assert html_extract.best_run([1, -2, 1]) == (0, 1)
