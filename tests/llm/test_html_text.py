import html
import re

import pytest

from riskframe.llm import html_text as H

LONG = "This paragraph is long enough to make the distribution surge, since it has far more than eighty-six characters in it. "


def test_given_pages_give_their_article(spark):
    """Brute force for these pages: the text between the article tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r for r in H.main_text(pages).collect()}
    rows = pages.collect()
    assert len(out) == len(rows)
    for p in rows:
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", p.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner))).split())
        assert out[p.page_id].text == want and out[p.page_id].n_chars == len(want) and out[p.page_id].url == p.url


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("<html></html>", ""), ("plain words", "plain words"), ("<p>Tiny.", "Tiny."),
    ("<p>a &lt; b &amp; c&nbsp;d  e\n f</p>", "a < b & c d e f"), ("<p>fo<b>ob</b>ar</p><p>x", "foobar x"),
    ("<p>kept</p><!-- gone", "kept"), ("<p>kept</p><script>if (a<b) '</p>'", "kept"), ("<p>1 < 2 > 0</p>", "1 < 2 > 0"),
    ("<ul><li><a href=x>only</a><li><a href=y>links</a></ul>", ""), ("<title>no</title><p>yes", "yes"),
])
def test_small_pages(page, want):
    assert H.extract(page) == want


@pytest.mark.parametrize("noise", [
    "<nav><ul><li><a href=x>Home</a></ul></nav>", f"<header><p>{LONG}</p></header>", f"<footer>{LONG}</footer>",
    f"<div class='sidebar'>{LONG}</div>", f"<div id='cookie-notice'><p>{LONG}</p></div>", f"<div class=\"ad\">{LONG}</div>",
    f"<form><label>{LONG}</label><input></form>", f"<style>p{{}} {LONG}</style>", f"<script>var x='<p>{LONG}</p>'</script>",
    f"<section id=comments><p>{LONG}</p></section>", f"<ol class='commentlist'><li>{LONG}</ol>", f"<aside>{LONG}</aside>",
    f"<div role=navigation>{LONG}</div>", f"<div hidden>{LONG}</div>", f"<article class='comment'><p>{LONG}</p></article>", f"<!-- {LONG} -->", f"<noscript>{LONG}</noscript>",
])
@pytest.mark.parametrize("shell", ["<article>{}</article>", "<div class='content'>{}</div>", "<main><div>{}</div></main>"])
def test_noise_goes_wherever_it_stands(noise, shell):
    body = f"<h1>Title here</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = f"Title here {LONG}Short. {LONG}".strip()
    assert H.extract(f"<html><body>{noise}{shell.format(body)}{noise}</body></html>") == want
    middle = f"<h1>Title here</h1><p>{LONG}</p>{noise}<p>Short.</p><p>{LONG}</p>"
    if "<header" not in noise or "article" not in shell and "main" not in shell:
        assert H.extract(f"<body>{shell.format(middle)}</body>") == want


def test_stretches_match_windows():
    weights = [0, 0, 10, 90, 0, 0, 0, 5, 0, 0, 0, 200, 0, 3]
    assert H.stretches(weights, 3, 86) == [(2, 4, True), (7, 8, False), (11, 14, True)]
    assert H.stretches([], 3, 86) == [] and H.stretches([0, 0], 3, 86) == []


def test_awkward_rows(spark):
    big = "<article>" + "<p>word</p>" * 50_000 + "</article>"
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>x"), (3, None, big), (4, "u", "<" * 5000 + "\"'" * 5000)],
                               "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    out = H.main_text(df).collect()
    assert len(out) == 5 and sorted(r.n_chars for r in out)[:3] == [0, 0, 1] and max(r.n_chars for r in out) == 5 * 50_000 - 1
    assert H.main_text(df.limit(0)).collect() == []


def test_short_sections_of_a_long_page_without_article_stay():
    def section(k, n):
        return "".join(f"<p>Section {k} has sentence {i}, which is long enough to be article text on a page like this one.</p>" for i in range(n))

    advert = '<div class="ad"><div>Buy now</div></div>'
    linked = '<div><div>' + "".join(f'<p><a href="/{i}">Another page of this site that is only named here, number {i}</a></p>' for i in range(30)) + (
        "<p>A line of plain text that is long enough to surge, although the block around it is nearly all links.</p></div></div>")
    sections = [section("one", 40), section("two", 3), section("three", 2), section("four", 1)]
    text = H.extract(f"<html><body><div>{advert.join(sections)}</div>{linked}</body></html>")
    assert [text.count(f"Section {k} ") for k in ("one", "two", "three", "four")] == [40, 3, 2, 1]
    assert "Buy now" not in text and "Another page" not in text


PARAGRAPHS = [f"Paragraph {i} of a text that runs on for a good while, so that every line of it has well over eighty characters." for i in range(6)]


def neutral(parts):
    """A page whose classes and elements say nothing: menus, article and footer are all divs."""
    menu = "".join(f"<li class='k{i}'><a href='/{i}'>Section {i}</a></li>" for i in range(12))
    return (f"<html><body><div class='q1'><div class='q2'><ul>{menu}</ul></div></div><div class='q3'><div class='q4'><div class='q5'>{parts}</div></div></div>"
            "<div class='q6'><div class='q7'><div class='q8'><a href='/x'>Terms</a> <a href='/y'>About us</a></div></div></div></body></html>")


def test_line_blocks_alone_find_the_text():
    page = neutral("".join(f"<p>{p}</p>" for p in PARAGRAPHS))
    assert H.extract(page) == " ".join(PARAGRAPHS)


def test_surge_and_window_decide():
    boxed = "</div></div></div><div class='r1'><div class='r2'><div class='r3'>"
    page = neutral(f"<p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]}</p>{boxed}<p>Two short words</p>{boxed}<p>{PARAGRAPHS[2]}</p><p>{PARAGRAPHS[3]}</p>")
    assert H.extract(page) == " ".join(PARAGRAPHS[:4])  # the short line between dives does not surge
    assert "Two short words" in H.extract(page, surge=5)
    assert "Two short words" in H.extract(page, window=20)
    assert H.extract(page, surge=10 ** 9) == " ".join(PARAGRAPHS[:2])  # no surge: the largest stretch
    inside = f"<body><article><p>{PARAGRAPHS[0]}</p>{boxed}<p>Two short words</p>{boxed}<p>{PARAGRAPHS[1]}</p></article>"
    assert H.extract(inside) == " ".join(PARAGRAPHS[:2]) and "Two short words" in H.extract(inside, surge=5)


@pytest.mark.parametrize("head", ["<head><title>x</title>", "<head><meta charset=utf-8><link rel=a><style>p{}</style><script>var a='</p>'</script>", "<head>", ""])
def test_head_without_its_end_tag(head):
    for body in ("<body>", ""):
        assert H.extract(f"<html>{head}{body}<div><p>{PARAGRAPHS[0]}</p></div>") == PARAGRAPHS[0]


@pytest.mark.parametrize("attribute", ["class='legal-history'", "id='social-security'", "class='share-price'", "class='notice-of-meeting'", "class='has-sidebar'",
                                       "class='cookie-recipe'", "class='searchable x'", "id='commentary'"])
def test_compounds_that_belong_to_the_text_stay(attribute):
    page = f"<body><article><p>{PARAGRAPHS[0]}</p><section {attribute}><p>{PARAGRAPHS[1]}</p></section><p>{PARAGRAPHS[2]}</p></article>"
    assert H.extract(page) == " ".join(PARAGRAPHS[:3])


@pytest.mark.parametrize("attribute", ["class='ad-container'", "class='comments-wrapper'", "id='article-comments'", "class='ad_slot_2'", "class='newsletterSignup'",
                                       "class='x related-articles'", "class='mobile-ad'", "class='share-buttons'", "class='reader-comments-list'"])
def test_wrappers_in_an_article_go(attribute):
    page = f"<body><article><p>{PARAGRAPHS[0]}</p><div {attribute}><p>{PARAGRAPHS[1]}</p></div><p>{PARAGRAPHS[2]}</p></article>"
    assert H.extract(page) == f"{PARAGRAPHS[0]} {PARAGRAPHS[2]}"


@pytest.mark.parametrize("attribute", ["class='cookie-wrapper'", "class='page-footer'", "id='site-header'", "class='fb-comments'"])
def test_wrappers_outside_an_article_go(attribute):
    page = f"<body><div {attribute}><p>{PARAGRAPHS[1]}</p></div><div><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[2]}</p></div>"
    assert H.extract(page) == f"{PARAGRAPHS[0]} {PARAGRAPHS[2]}"
