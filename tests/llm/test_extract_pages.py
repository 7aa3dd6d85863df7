"""Whole articles survive their wrappers; the longest common subsequence against brute force; long pages."""

import random
import time

import pytest

from veil.llm.extract import common, parse

WRAPPERS = ["page has-sidebar", "with-nav wide", "no-banner", "site", "layout", "container", "content-area", "wrapper",
            "header-fixed", "sidebar", "page-with-footer", "menu-open", "cookie-banner-visible", "hide-comments",
            "modal-open", "theme-alert", "search-results-page", "share-enabled", "widget-area", "ads-enabled"]


def kept(html):
    return parse(html).blocks


@pytest.mark.parametrize("name", WRAPPERS)
def test_no_wrapper_takes_the_article(name):
    assert kept(f'<div class="{name}"><article><p>Text.</p></article></div>') == ["Text."]
    assert kept(f'<nav>m</nav><div class="{name}"><div><main><p>Text.</p></main></div><aside>x</aside></div>') == ["Text."]


def test_forms_headlines_and_paragraphs():
    assert kept('<form id="aspnetForm"><div class="nav">m</div><article><h1>H</h1></article></form>') == ["H"]
    assert kept('<article><div class="article-header"><h1>Headline</h1></div><p>T</p></article>') == ["Headline", "T"]
    assert kept('<article><p class="share-price">5</p><section class="notice-of-meeting"><p>N</p></section></article>') == ["5", "N"]
    assert kept('<article><div class="share">s</div><div class="related">r</div><div class="comments"><p>c</p></div><p>T</p></article>') == ["T"]


def test_readers_comments_are_no_article():
    html = ('<article><p>T</p></article><div class="comments"><article><p>c</p></article></div>'
            '<article class="comment"><p>d</p></article><aside><article>teaser</article></aside>')
    assert kept(html) == ["T"]
    assert kept(f"<form>{html}</form>") == ["T"]
    assert kept('<div class="site-header">x</div><div class="ad-slot">y</div><div class="nav-links">z</div><p>T</p>') == ["T"]


def test_common_lines_against_brute_force():
    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rnd = random.Random(4)
    for _ in range(400):
        a, b = ([rnd.choice("abcdefgh"[:rnd.randint(1, 8)]) for _ in range(rnd.randrange(25))] for _ in range(2))
        at = sorted(common(a, b))
        assert len(at) == length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in at)  # a subsequence of b


def test_long_pages_take_seconds():
    lines = [f"line {i}" for i in range(20000)]
    mixed = lines[:]
    random.Random(2).shuffle(mixed)
    start = time.time()
    assert len(common(lines, mixed)) > 200
    assert parse("<p>a" + "</b>" * 100_000 + "</p>" + "<div>" * 20_000).blocks == ["a"]
    assert time.time() - start < 20
