"""Nested wrappers, long sections, lists, tables and layout names lose no block of an article."""

import time

import pytest

from tidelake.llm import html_text

LONG = "A long sentence of the text, with marks. " * 20
LONG = LONG.strip()


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<article><h1>Title</h1><p>Lead</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></article>",
         ["Title", "Lead", LONG, LONG]),
        (f"<article><h1>T</h1><p>Short.</p><section><p>{LONG}</p><p>{LONG}</p></section><p>End.</p></article>",
         ["T", "Short.", LONG, LONG, "End."]),
        (f"<main><p>One.</p><ul><li>{LONG}</li><li>b</li></ul></main>", ["One.", LONG, "b"]),
        (f"<article><p>One.</p><blockquote>{LONG}</blockquote><p>Two.</p></article>", ["One.", LONG, "Two."]),
        (f"<article><p>One.</p><pre>{LONG}</pre><table><tr><td>a</td><td>{LONG}</td></tr></table></article>",
         ["One.", LONG, "a", LONG]),
        (f"<div class='layout no-sidebar'><article><h1>T</h1><p>{LONG}</p></article></div>", ["T", LONG]),
        (f"<div class=with-sidebar><h1>T</h1><p>{LONG}</p></div>", ["T", LONG]),
        (f"<div class=sidebar-right><article><p>{LONG}</p></article><div class=sidebar><p>S</p></div></div>", [LONG]),
        (f"<article><div class=entry-header><h1>T</h1></div><p>{LONG}</p></article>", ["T", LONG]),
        (f"<article><p>{LONG}</p><section class=related-work><p>{LONG}</p></section></article>", [LONG, LONG]),
        (f"<div><p>{LONG}</p><div class=site-header><p>S</p></div><div id=comment-list><p>{LONG}</p></div></div>", [LONG]),
        (f"<article><p>{LONG}</p><div class=related-posts><p>More to read.</p></div></article>", [LONG]),
    ],
)
def test_regions(html, want):
    assert html_text.main_text(html).split("\n") == want


@pytest.mark.parametrize(
    "page",
    ["<b " * 200_000 + '" >', "<b '" * 150_000, "<!" * 200_000, '<a "x' * 150_000 + ">", "<script " * 80_000,
     "<p>" * 150_000, "< " * 300_000, "<b x='" + "<i " * 200_000, "&" * 300_000, "<!--" * 150_000],
)
def test_tags_that_never_end_take_linear_time(page):
    started = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - started < 8


def test_marks_of_a_tag_may_stand_in_quotes():
    page = "<article><p title='a > b < c'>One &lt; two, and three.</p><p>Four < five.</p></article>"
    assert html_text.main_text(page) == "One < two, and three.\nFour < five."
