"""Selectors with nesting."""

import time

import pytest

from digestry.sources import html_select as H


def texts(page, selector):
    return [fields[0][0] for fields in H.select_blocks(f"<main>{page}</main>", "main", [selector])][0]


PAGE = ('<ul class="a list"><li id=x>1<ul><li>2</ul><li class="b c">3<p>4<p title="t-u v">5</ul>'
        '<div><div class=deep>6<span lang="en-GB">7</span></div>8</div><h2>9</h2><p>10<br/>11</p><a href="/q?a=1&amp;b=2">12</a>')


@pytest.mark.parametrize(("selector", "want"), [
    ("li", "1223" + "45"), ("ul > li > ul > li", "2"), ("ul ul li", "2"), ("ul li li", "2"), ("#x", "12"), ("li#x.b", ""), (".b.c", "345"), (".list .c p", "45"),
    ("p + p", "5"), ("p ~ p", "5"), ("h2 + p", "1011"), ("h2 ~ a", "12"), ("div div", "67"), ("div", "67867"), ("[title]", "5"), ("p[title~=v]", "5"), ("[title=t]", ""),
    ("[lang|=en]", "7"), ("[title^='t-']", "5"), ('[title$="v"]', "5"), ("[title*=u]", "5"), ("h2, h2 + p, .nowhere", "91011"), ("*#x", "12"), ("DIV > .deep span", "7"),
    ("body li", ""), ("a[href='/q?a=1&b=2']", "12")])
def test_selectors(selector, want):
    assert texts(PAGE, selector) == want


@pytest.mark.parametrize("selector", ["", " ", "a:hover", "li:first-child", "> a", "a >", "a,,b", ".", "#", "a[", "[=x]", "a{b}", "1a"])
def test_unsupported(selector):
    assert H.parse_selector(selector) is None


def test_blocks_in_blocks():
    page = '<div class="post"><div class="t">T</div><p>one</p><div class=post><div class=t>U</div></div></div><div class="post">'
    got = [[text for text, _ in fields] for fields in H.select_blocks(page, "div.post", [".t", None, "p"])]
    assert got == [["TU", "", "one"], ["U", "", ""], ["", "", ""]]


def test_text_that_is_none():
    page = "<main>a<script>if (1 < 2) '<p>x</p>'</script><!-- <p>y</p> --><style>p{}</style>b &lt;p&gt; &eacute; 1 < 2<textarea><p>z</textarea></main>"
    assert texts(page, "p") == ""
    assert next(H.select_blocks(page, "body, main", ["main"]))[0] == ("", None)
    assert next(H.select_blocks(f"<div>{page}</div>", "div", ["main"]))[0][0] == "ab <p> é 1 < 2<p>z"


@pytest.mark.parametrize("page", ["<div>x" * 150_000, "<a b='" * 150_000, '<a b="x' * 150_000, "<!--" * 200_000, "</p>" * 200_000, "<" * 500_000, "<p><li>" * 100_000,
                                  "<script>" * 100_000, "<div class='" + "a " * 300_000 + "'>", "<ul><li>" * 80_000 + "</ul>" * 80_000, "&amp" * 200_000])
def test_long_pages_take_linear_time(page):
    start = time.process_time()
    list(H.select_blocks(page, "section", ["div > p .x, a ~ b", "li"]))
    assert time.process_time() - start < 20
