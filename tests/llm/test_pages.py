"""Article text that stands in links, in several parts or under wrappers with telling names is kept."""

import time

import pytest
from cropgrid.llm.html_text import extract, main_text

LONG = "A sentence of the story that goes on for a while. " * 4


def test_links_inside_an_article_stay():
    page = "<article><h2><a href=x>All of it a link</a></h2><p>Text.</p><ul><li><a href=y>one</a><li><a href=z>two</a></ul><nav><a href=n>next</a></nav></article><p>out"
    assert main_text(page) == "All of it a link\nText.\none\ntwo"


def test_all_parts_stay():
    cut = "".join(f"<p><a href=x>link {i}</a></p>" for i in range(4))
    page = f"<div><h1>Title</h1><p>By Ann</p><p>Monday</p><p>Lead.</p><p>{LONG}</p>{cut}<p>{LONG * 2}</p><p><a href=s>a source</a></p><p>{LONG}</p></div>"
    text = main_text(page).split("\n")
    assert text == ["Title", "By Ann", "Monday", "Lead.", LONG.strip(), (LONG * 2).strip(), "a source", LONG.strip()]


def test_names_of_wrappers():
    page = f"<div class='layout has-sidebar'><div class=sidebar>aside</div><article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><div class=share>tweet</div></article></div>"
    assert main_text(page) == "Title\n" + LONG.strip()
    assert main_text(f"<form id=f><div id='page-header'><main><p>short</p></main></div></form><footer>{LONG}</footer>") == "short"
    assert main_text(f"<div class='layout has-sidebar'><p>{LONG}</p><div class=sidebar>aside</div></div>") == LONG.strip()
    comments = f"<div id=comments><article><p>{LONG * 3}</p></article></div>"
    assert main_text(f"<div><p>{LONG}</p></div>{comments}") == LONG.strip()
    assert main_text("<div class=menu><a href=x>one</a></div><div class=sidebar><p>side</p></div><p>the text</p>") == "the text"


def test_no_text_is_lost_to_markup():
    assert main_text("<p title=it's>Hello first</p><p>I don't know</p><p>end of it's</p>") == "Hello first\nI don't know\nend of it's"
    assert main_text("<p>some words</p>< 5 items remain") == "some words\n< 5 items remain"
    assert main_text("<p>a < b, c </ d</p><p title=\"x>y\">z<br/>w</p>") == "a < b, c </ d\nz w"
    assert main_text("<article><div class=share-of-market>10 %</div><p class='notice-period'>May</p><div class='share-buttons'>x</div></article>") == "10 %\nMay"
    assert main_text("<p>one</p><svg/><p>two</p><select><option>three</p><p>four") == "one\ntwo\nthree\nfour"
    assert main_text("<p>a<!-->b<!-- c --!>d<SCRIPT>if (a</b) x('</p>')</Script >e<style>p{}</style\n>f") == "a b d e f"
    assert main_text("<p title='never closed>kept</p><p>and kept") == "kept\nand kept"
    assert main_text("<p>&#" + "9" * 5000 + ";&#0000000065;</p>") == "\ufffdA"


def test_lines_beside_an_article_do_not_surge():
    page = f"<p>{LONG}</p><article><p>short</p></article><p>{LONG}</p><article><p><a href=x>link</a></p></article>"
    assert main_text(page).startswith("short\n") and main_text(page).endswith("\nlink")
    far = "".join(f"<p>{LONG}{i}</p>" for i in range(5))
    assert main_text(f"{far}<article><p>one</p></article>{far}<article><p>two</p></article>{far}") == "one\ntwo"


@pytest.mark.parametrize("page", ["<script " * 100000, "<a " * 100000, "<p title='" * 99999, "<!--" * 100000, "</" * 100000, "<svg>" * 100000, "<p a=b " * 50000,
                                  "<div>" * 50000 + "</x>" * 50000, "<" * 200000, "<script>" * 50000, "<p class='" + "nav_" * 50000 + "!'>", "<nav>" * 50000])
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 5


def test_tables(spark):
    kinds = "page_id long, url string, html string, text string, n_chars string"
    assert extract(spark.createDataFrame([], kinds)).count() == 0
    rows = [(1, "u", "<p>a", "x", "y"), (1, "u", "<p>a", "x", "y"), (None, None, None, None, None), (2, "v", f"<p>{LONG * 20000}</p>", "", "")]
    found = [tuple(r) for r in extract(spark.createDataFrame(rows, kinds)).collect()]
    assert sorted(found, key=str) == sorted([(1, "u", "a", 1)] * 2 + [(None, None, "", 0), (2, "v", (LONG * 20000).strip(), len(LONG) * 20000 - 1)], key=str)
