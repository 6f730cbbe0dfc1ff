"""Malformed and deeply nested pages, and class names that say little."""

import time

import pytest

from inkframe.llm import html_extract

LONG = "This is a long paragraph of the article, with a good many words in it, so that it reads as a text that people write."
MALFORMED = {
    "<p>a</p><!-- cut off": "a", "<!DOCTYPE html [<!ELEMENT a (b)>]><p>x.": "x.", "<p>t</p><![CDATA[": "t", "<![foo[bar]]>a": "a", "<![ ]>": "", "<![>": "", "<![%x;[": "", "<p>ok</p><p class='a": "ok",
    "<p>ok</p": "ok", '<p>ok<b title="a>b': "ok", "<p>ok</p><?php echo 1": "ok", "<p>a<!-->b<!--->c<!-- x --!>d": "abcd", "<!>x": "x", "<p>1 < 2 and 3 > 2": "1 < 2 and 3 > 2", "<p>ok<script>if (a<b": "ok",
}


def test_malformed_pages_end_no_job(spark):
    pages = spark.createDataFrame([(i, "u", html) for i, html in enumerate(MALFORMED)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert [got[i] for i in range(len(MALFORMED))] == list(MALFORMED.values())


@pytest.mark.parametrize("page", [
    '<div id="page" class="has-sidebar"><div class="post"><p>{}</p></div></div>', '<div class="site header-fixed"><p>{}</p></div>', '<form id="aspnetForm"><p>{}</p></form>', '<div class="legal-analysis"><p>{}</p></div>',
    '<div class="content-form"><p>{}</p></div>',
])
def test_a_part_of_a_class_name_empties_no_page(page):
    assert html_extract.main_text(page.format(LONG)) == LONG


def test_class_words_inside_an_article_are_weighed_against_text_and_neighbours():
    page = f'<article><p>{LONG}</p><div class="widget gallery"><p>{LONG}</p></div><div class="share-buttons"><a href=x>Mail</a> <a href=y>Print</a></div><p>{LONG}</p></article><div class="comments"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>'
    assert html_extract.main_text(page) == "\n".join([LONG] * 3)
    alone = '<article><p>One two.</p><div class="notice">Read the rules before use of this.</div><p>Three four.</p></article>'
    assert [k for *_, k in html_extract.labelled(alone)] == [True, False, True]


def test_nesting_costs_no_square():
    began = time.process_time()
    for page in ("<div>" * 16_000 + "</span>" * 16_000 + "x", "<p>a<b>" * 8_000 + "<h1>x" * 8_000, "<head><noscript>" + "<b>" * 16_000 + "<i>x" * 8_000, "<b>" * 16_000 + "<p>x</p>" * 8_000):
        html_extract.main_text(page)
    assert time.process_time() - began < 8
