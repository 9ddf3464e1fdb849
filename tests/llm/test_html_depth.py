"""Main text of pages that are nested deeply: the same as of the plain page, in linear time."""

import time

import pytest

from graphloom.llm import html_extract

MENU = "<nav class=menu><ul>" + "".join(f"<li><a href=/x>Menu item {k}</a></li>" for k in range(8)) + "</ul></nav>"
ARTICLE = "<article><h1>A fine title</h1>" + "".join(f"<p>This is paragraph {k} of the main text, with enough words, commas and stops to be seen as such. It goes on.</p>" for k in range(6)) + "</article>"
COMMENTS = "<div class=comments><h3>Comments</h3>" + "".join(f"<div class=comment><b>Joe</b><p>I like what you say here, number {k}.</p></div>" for k in range(5)) + "</div>"
FOOTER = "<footer>&copy; 2020 Some company. <a href=/i>Imprint</a></footer>"


@pytest.mark.parametrize("tag", ["<div>", "<div class=wrap>\n", '<div id="content">', "<section>"])
def test_menu_comments_and_footer_go_at_any_depth(tag):
    model, body = html_extract.train(), MENU + ARTICLE + COMMENTS + FOOTER
    want = html_extract.extract_many([body], model)[0]
    assert want.startswith("A fine title\nThis is paragraph 0") and "Menu" not in want and "Joe" not in want and "Imprint" not in want
    close = "</section>" if "section" in tag else "</div>"
    for depth in (1, 63, 64, 65, 200, 5000):
        assert html_extract.extract_many([tag * depth + body + close * depth], model)[0] == want, depth
        assert html_extract.extract_many([MENU + tag * depth + ARTICLE + close * depth + COMMENTS + FOOTER], model)[0] == want, depth


def test_deep_lists_keep_their_tags():
    """Beyond 64 levels, too, an element has its own tag and links, and ends where it must."""
    root = html_extract.parse("<ul><li>" * 200 + "x<p>y<p>z</ul>w" + "<table><tr><td>a<td>b")
    depth, node = 0, root
    while node.kids:
        node, depth = node.kids[0], depth + 1
    assert depth == 401 and node.text == "x" and [k.tag for k in node.parent.kids] == ["#text", "p", "p"]
    outer = node.parent.parent.parent
    assert [k.tag for k in outer.kids] == ["ul", "#text", "table"] and [k.tag for k in outer.kids[2].kids[0].kids] == ["td", "td"]


@pytest.mark.parametrize("soup", ["<b>", "<div>", "<p><b>", "<table><tr><td>", "<li><dt></b>"])
def test_time_goes_with_the_length(soup):
    def seconds(n):
        began = time.process_time()
        html_extract.parse(soup * n + "text")
        return time.process_time() - began

    seconds(2000)
    assert seconds(40_000) < 16 * max(0.02, seconds(5000))


def test_open_elements_beside_which_many_begin():
    began = time.process_time()
    html_extract.parse("<li>" + "<b>" * 30_000 + "<dt></dt>" * 30_000)
    assert time.process_time() - began < 10
