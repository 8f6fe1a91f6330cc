"""Main text of pages: nested, unclosed and stray tags, lists of links, raw content."""

from __future__ import annotations

import time

from factgraph.sources import readers
from factgraph.sources.main_text import outside_boilerplate


def words(html):
    return outside_boilerplate(html).split()


def test_nested_boilerplate_goes_as_a_whole():
    assert words("<nav>a<nav>b</nav>c</nav>kept<form>d<form>e</form>f</form>") == ["kept"]
    assert words("<header><div>x<header>y</header></div>z</header><p>kept</p><aside>q</aside>") == ["kept"]


def test_unclosed_and_stray_tags():
    assert words("<div><nav>menu<ul><li>one</div><p>kept") == ["kept"]
    assert words("</nav>kept</div> <p>too<b>bold</p> end</b>") == ["kept", "too", "bold", "end"]
    assert words("before <footer>to the end <p>of the page") == ["before"]
    assert words("a < b and 1<2 <3") == ["a", "<", "b", "and", "1<2", "<3"]


def test_raw_content_and_comments():
    assert words("<script>if (a < b) { x = '</p><nav>' }</SCRIPT>kept<style>p > q {}</style><!-- <nav> -->too<!-- open") == ["kept", "too"]
    assert words("kept<script>never closed <p>text") == ["kept"]


def test_lists_of_links_go_and_linked_prose_stays():
    links = "".join(f"<li><a href=/{i}>link {i}</a></li>" for i in range(6))
    assert words(f"<div><ul>{links}</ul></div><p>prose with <a href=x>one link</a> in it</p>") == "prose with one link in it".split()
    assert words("<p><a href=1>a</a> and <a href=2>b</a> are two links in a text that is longer than they</p>")[:3] == ["a", "and", "b"]


def test_time_is_that_of_the_length():
    began = time.time()
    outside_boilerplate("<div>" * 20_000 + "text" + "</div>" * 20_000)
    outside_boilerplate("</p>" * 50_000 + "<" * 50_000)
    assert time.time() - began < 5


def test_pages(spark):
    prose = "plain words of a text " * 20
    rows = [(1, f"<title>T</title><nav>x<nav>y</nav>z</nav><p>{prose}&amp; more</p>"), (2, None), (3, ""), (4, "<p>short</p>")]
    got = readers.extract_main_text(spark.createDataFrame(rows, "page_id long, html string")).collect()
    assert [(r["page_id"], r["title"]) for r in got] == [(1, "T")] and got[0]["text"] == f"T {prose.strip()} & more"
