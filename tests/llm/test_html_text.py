"""Main text of pages: the tree, densities by hand, odd pages, and the given table."""

import html as html_lib
import math
import random
import re
import time

import pytest

from corpuskit.llm import html_text
from corpuskit.llm.html_text import main_text, parse
from corpuskit.llm.queries import op11_html_extraction, table

SF_DIR = "/root/testdata/sf0.001"
LONG = "A sentence of plain text that goes on for a while, as articles do, until it ends. "


def shape(node):
    return node if isinstance(node, str) else (node.tag, *map(shape, node.parts))


@pytest.mark.parametrize("page, expected", [
    ("<p>a<p>b", (("p", "a"), ("p", "b"))),
    ("<p><b>a<br><p>b</p>", (("p", ("b", "a", ("br",))), ("p", "b"))),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", (("ul", ("li", "a"), ("li", "b", ("ul", ("li", "c"))), ("li", "d")),)),
    ("<table><tr><td>a<td>b<tr><td>c</table>x", (("table", ("tr", ("td", "a"), ("td", "b")), ("tr", ("td", "c"))), "x")),
    ("<dl><dt>a<dd>b<dt>c</dl>", (("dl", ("dt", "a"), ("dd", "b"), ("dt", "c")),)),
    ("a </b> c</p>", ("a ", " c")),
    ("<a title='x > y' data=\"it's\">t</a>", (("a", "t"),)),
    ("1 < 2 <3 & 4 &lt; 5 &amp;amp; &#x41;&copy;", ("1 ", "<", " 2 ", "<", "3 & 4 < 5 &amp; A©")),
    ("<script>if (a < b) '</p>' </scriptx></script>z", (("script", "if (a < b) '</p>' </scriptx>"), "z")),
    ("<!-- <p> --><!doctype html><?x y?></ >b<!-->c<!--->d<!-- open <p>e", ("b", "c", "d")),
    ("<style>p{}", (("style", "p{}"),)),
    ("<b", ()), ("<", ("<",)), ("x<b c='", ("x",)), ("<i a=\"1>b</i>c", (("i", "b"), "c")),
])
def test_tree(page, expected):
    assert tuple(map(shape, parse(page).parts)) == expected


def test_hostile_pages_take_time_in_proportion():
    for unit in ["<a \"", "<!--", "<div>", "</div><p>", "<script>", "<b><p>", "<li><b>", "<dd>", "<table><td>", "&#x", "<a href='", "<x"]:
        began = time.perf_counter()
        main_text(unit * 40_000)
        assert time.perf_counter() - began < 8, unit
    deep = "<div>" * 5_000 + "deep text" + "</div>" * 5_000
    assert main_text(deep) == "deep text"


def brute_density(node, body):
    """The formula of composite text density, with figures counted anew for every node."""
    def count(n, in_link=False):
        chars = tags = link_chars = link_tags = 0
        in_link = in_link or n.tag == "a"
        tags += n.tag not in html_text.VOID
        link_tags += n.tag == "a"
        for part in n.parts:
            if isinstance(part, str):
                size = len(re.sub(r"\s+", "", part))
                chars += size
                link_chars += size * in_link
            elif not html_text.is_apart(part):
                c, t, lc, lt = count(part, in_link)
                chars, tags, link_chars, link_tags = chars + c, tags + t, link_chars + lc, link_tags + lt
        return chars, tags, link_chars, link_tags

    (c, t, lc, lt), (bc, _, blc, _) = count(node), count(body)
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * max(1, lc) + blc / bc * c + math.e)
    return c / t * math.log(c / max(1, lc) * t / max(1, lt), base)


def test_densities_equal_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        page = "<body>" + "".join(
            rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "<br>", "word ", LONG, "<nav>n</nav>"])
            for _ in range(60))
        root = parse(page)
        html_text.set_apart(root)
        body = next(n for n in html_text._in_order(root) if n.tag == "body")
        nodes = html_text.measure(body)
        for node in nodes:
            assert node.density == pytest.approx(brute_density(node, body))
            below = sum(brute_density(c, body) for c in node.children if not html_text.is_apart(c))
            own = len(re.sub(r"\s+", "", "".join(p for p in node.parts if isinstance(p, str)))) * (node.tag != "a")
            text = html_text.Node("#text", None, parts=["x" * own])
            assert node.density_sum == pytest.approx(below + brute_density(text, body))


ARTICLE = f"<h1>The title</h1><p>{LONG * 3}</p><p>Short.</p><p>{LONG * 2} and <a href=x>a link</a> in it</p>"
EXPECTED = "\n\n".join(["The title", (LONG * 3).strip(), "Short.", (LONG * 2).strip() + " and a link in it"])
MENU = "<ul>" + "<li><a href=/x>Menu entry</a></li>" * 9 + "</ul>"


@pytest.mark.parametrize("before, around, after", [
    ("<nav>" + MENU + "</nav>", "article", "<footer>" + LONG + "</footer>"),
    ("<div class='top-menu'>" + MENU + "</div>", "div id=content", f"<div class=sidebar><p>{LONG * 9}</p></div>"),
    (MENU, "main", "<aside>" + LONG * 5 + "</aside>"),
    (MENU, "div", f"<div id=comments><p>{LONG * 5}</p><article class=comment><p>{LONG * 9}</p></article></div>"),
    (f"<header><h1>Site</h1>{LONG}</header>", "section", MENU + "<p>&copy; 2020</p>"),
    (f"<div role=alert>{LONG * 4}</div><form><label>{LONG * 5}</label></form>", "div class='post has-sidebar no-comments'", MENU),
    (f"<div style='display: none'>{LONG * 20}</div><p hidden>{LONG * 20}</p>", "article", f"<div class='cookieNotice'>{LONG * 9}</div>"),
])
def test_only_the_article_stays(before, around, after):
    page = f"<html><head><title>T</title></head><body>{before}<{around}>{ARTICLE}</{around.split()[0]}>{after}</body></html>"
    assert main_text(page) == EXPECTED


def test_parts_of_an_article_stay_together():
    sections = "".join(f"<section><h2>Head {i}</h2><p>{LONG * (i + 1)}</p></section>" for i in range(3))
    page = f"<body>{MENU}<div><h1>Title</h1>{sections}<div class=ad>{LONG}</div><p>Yes.</p></div>{MENU}</body>"
    expected = ["Title", *[t for i in range(3) for t in (f"Head {i}", (LONG * (i + 1)).strip())], "Yes."]
    assert main_text(page).split("\n\n") == expected


def test_blocks_and_white_space():
    page = "<article> a&nbsp;\n b<br>c <i>d</i>e<ul><li>f\t</li><li> </li></ul>g<pre>h\n\ni</pre><script>x</script>j</article>"
    assert main_text(page) == "a b c de\n\nf\n\ng\n\nh i\n\nj"
    assert main_text("plain   text only") == "plain text only"
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<nav>x</nav>") == ""


def test_given_pages(spark):
    pages = {r.page_id: r for r in table(spark, SF_DIR, "pages").collect()}
    for r in op11_html_extraction(spark, SF_DIR).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id].html, re.DOTALL)[1]
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inner.replace("<br>", " "))]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_rows(spark):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    rows = [(1, "u", None, "clash", "x"), (1, None, "", None, None), (None, "v", "<p>é😀</p>", "", ""), (None, "v", "<p>é😀</p>", "", ""),
            (2, "w", f"<article><p>{'long ' * 300_000}</p></article>", "", "")]
    got = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert got[0].asDict().keys() == {"id", "url", "text", "n_chars"}
    found = sorted(((r.id, r.url, r.text[:9], r.n_chars) for r in got), key=str)
    assert found == sorted([(1, "u", "", 0), (1, None, "", 0), (None, "v", "é😀", 2), (None, "v", "é😀", 2), (2, "w", "long long", 1_499_999)], key=str)
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0
