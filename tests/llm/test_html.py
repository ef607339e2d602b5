"""Main-text extraction on pages with known articles."""

import random
import time
from collections import Counter

import pytest

from trendframe.llm import html_extract
from trendframe.llm.common import shipped

CASES = [
    ("<p>a  b<br>c\n\td</p><p>&amp;&eacute;&#8364;</p>", "a b c d &é€"),
    ("<h1>T</h1><p><b>open <i>bold<p>next</p>", "T open bold next"),
    ("<p>x<script>var a='</p>'</script>y</p><style>p{}</style>", "xy"),
    ("<p>one</p><!-- <p>no</p> --><ul><li>two<li>three</ul>", "one two three"),
    ("<p>keep</p><aside>no</aside><div class='share-bar'>no</div><form><p>no</p></form><div id='comments'><p>no</p></div>", "keep"),
    ("<p>keep</p><div class='ad'>no <div>no</div> no</div><p>more</p>", "keep more"),
    ("<p>keep</p><nav><ul><li>no</ul></nav><div class=cookie-notice>no</div><div hidden>no</div>", "keep"),
    ("<blockquote>said</blockquote><table><tr><td>1<td>2</table>", "said 1 2"),
    ("", ""),
]


def page(body):
    return (f"<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body class='x has-sidebar'><header>no"
            f"</header><nav><a href='/'>menu item one</a> <a href='/b'>menu item two</a></nav><div class='wrap'><article>{body}"
            f"</article><div class='sidebar'><p>a sidebar with a good deal of text in it, more than most articles have here"
            f"</p></div></div><section class='comments'><p>a reader's comment</p></section><footer>no</footer></body></html>")


def frame(spark, data):
    return shipped(spark).createDataFrame(data, "page_id long, url string, html string, host string, paths int, salt int")


def test_articles_of_one_host(spark):
    data = [(k, f"https://WWW.example.com/{k}", page(b), "h", 1, 2) for k, (b, _) in enumerate(CASES)]
    out = {r.page_id: r for r in html_extract.extract(frame(spark, data)).collect()}
    for k, (_, want) in enumerate(CASES):
        assert out[k].text == want, k
        assert out[k].n_chars == len(want)


def test_page_follows_its_host(spark):
    """A page whose longest container is another block follows the path the host's pages voted for."""
    good = "<body><div class='post'><p>{}</p></div><div class='extra'><p>{}</p></div></body>"
    data = [(k, "http://a.example/x", good.format("the article text " * 20, "short"), "", 0, 0) for k in range(5)]
    data += [(9, "http://a.example/y", good.format("brief article", "a long list of links and notes " * 30), "", 0, 0)]
    data += [(10, "http://b.example/y", "<body><div class='odd12'>alone</div></body>", "", 0, 0)]
    out = {r.page_id: r for r in html_extract.extract(frame(spark, data)).collect()}
    assert out[9].text == "brief article" and out[9].by_host
    assert out[10].text == "alone"


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a b"), ("a < b & c", "a < b & c"),
    ("<div><p>never <b>closed", "never closed"), ("<script>never closed", ""), ("<nav>never closed<p>text", "never closed text"),
    ("<p>" + "long " * 50000, ("long " * 50000).strip())])
def test_odd_pages(html, want):
    assert html_extract.parse(html or "").own() == want


def test_empty_table_null_and_repeated_rows(spark):
    assert html_extract.extract(frame(spark, [])).count() == 0
    data = [(1, None, None, "", 0, 0), (1, None, None, "", 0, 0), (None, "nonsense", "<p>x", "", 0, 0)]
    out = html_extract.extract(frame(spark, data)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "x", 1), (1, "", 0), (1, "", 0)]


MB = 1_000_000
MALFORMED = {
    "unclosed skipped": "<nav>" * (MB // 5), "unclosed quotes": "<a x='y " * (MB // 8),
    "mixed quotes": "<div x='y z=\"> " * (MB // 15), "deep containers": "<div>" * (MB // 5), "deep lists": "<ul>" * (MB // 4),
    "ends without a start": "<div>" * (MB // 10) + "</p>" * (MB // 10), "long name": "<div " + "a" * MB + ">x",
    "unclosed declarations": "<! " * (MB // 3), "unclosed comments": "<!--" * (MB // 4), "raw in raw": "<script>" * (MB // 8),
    "cells": "<table><tr><td>" * (MB // 15), "brackets": "<" * MB, "paragraphs": "<p>x" * (MB // 4),
    "blanks in a tag": "<div a" + " " * MB + "b>",
}


@pytest.mark.parametrize("kind", MALFORMED)
def test_malformed_pages_take_linear_time(kind):
    """A megabyte of each; the quadratic forms of this took hours, so the bound is loose."""
    start = time.process_time()
    page = html_extract.parse(MALFORMED[kind])
    k = page.best()
    if k is not None:
        assert page.by_paths([page.path_of(k)]) is not None
    page.own()
    assert time.process_time() - start < 20


@pytest.mark.parametrize("html,want", [
    ("<p>&#" + "9" * 5000 + "; &#" + "0" * 5000 + "65;", "� A"), ("<p>a <a x='y>b</a> c", "a b c"),
    ("<p>x <b title=\"a>b\">y</b>", "x y"), ("<p>x</p><a href='cut off", "x"),
    ("<p>a</p><nav>no<nav>no</nav>no</nav><p>b", "a b"), ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a b c")])
def test_broken_markup(html, want):
    assert html_extract.parse(html).own() == want


def test_pages_follow_the_vote_of_their_host(spark):
    """Generated hosts, a tenth of whose pages have a longer list than article, against a plain count of votes."""
    rng = random.Random(4)
    data, article = [], {}
    for k in range(400):
        host = rng.randrange(8)
        odd = rng.random() < 0.1
        text = " ".join(f"word{rng.randrange(99)}" for _ in range(5 if odd else 80))
        other = " ".join(f"entry{rng.randrange(99)}" for _ in range(80 if odd else 5))
        article[k] = text
        data.append((k, f"https://h{host}.example/{k}", f"<body><div class='post{k}'><p>{text}</p></div><div class='extra'><p>{other}</p></div></body>",
                     "", 0, 0))
    count = Counter()
    for _, url, html, *_ in data:
        page = html_extract.parse(html)
        count[url.split("/")[2], page.path_of(page.best())] += 1
    ranked = {}
    for (h, path), n in sorted(count.items(), key=lambda x: (-x[1], x[0][1])):
        ranked.setdefault(h, []).append(path)
    got = {r.page_id: r for r in html_extract.extract(frame(spark, data)).collect()}
    odd_pages = 0
    for k, url, html, *_ in data:
        page = html_extract.parse(html)
        assert got[k].text == page.by_paths(ranked[url.split("/")[2]]) == article[k]
        odd_pages += page.own() != article[k]
    assert odd_pages > 20
