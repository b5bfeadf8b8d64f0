"""The main text of pages is chosen by composite text density: against the definition on a tree, and on pages without telling elements."""

import math
import time
import xml.etree.ElementTree as tree

import pytest

from foliosmith.llm import htmltext

LONG = "The committee met in the spring to discuss the harvest and found that the river had risen by a good deal since the year before."
MORE = "Farmers from the upper valley reported that seed was short, and several asked for help with fences after the flood had gone."
LINKS = '<a href="1">Home</a> <a href="2">News</a> <a href="3">About</a>'


def by_definition(source: str):
    """(density, sum) of each element of a well-formed page in page order, straight from the formula."""
    root = tree.fromstring(source)

    def size(text):
        return len("".join((text or "").split()))

    def chars(node):
        return size(node.text) + sum(chars(k) + size(k.tail) for k in node)

    def link_chars(node, inside=False):
        inside = inside or node.tag == "a"
        return (size(node.text) if inside else 0) + sum(link_chars(k, inside) + (size(k.tail) if inside else 0) for k in node)

    def tags(node):
        return len(list(node.iter())) - 1

    def links(node):
        return len(list(node.iter("a"))) - (node.tag == "a")

    ratio = link_chars(root) / max(chars(root), 1)

    def density(c, t, lc, lt):
        if not c:
            return 0.0
        base = 1 + math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
        return c / max(t, 1) * math.log(max(1, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / math.log(base)

    def of(node, inside=False):
        return density(chars(node), tags(node), link_chars(node, inside), links(node))

    found = []
    for node in root.iter():
        within_link = any(node in list(a.iter()) for a in root.iter("a"))
        own = size(node.text) + sum(size(k.tail) for k in node)
        total = density(own, 1, own if within_link else 0, 0) + sum(of(k, within_link or k.tag == "a") for k in node)
        found.append((of(node, within_link), total))
    return found


@pytest.mark.parametrize("inner", [
    f"<div><p>{LONG}</p><p>{MORE}</p></div><div>{LINKS}</div>",
    f"<div>own text {LONG}<b>bold</b> tail <i>x</i></div><ul><li><a><b>in a link</b></a></li><li>out</li></ul>",
    f"<section><div><p>{LONG}</p></div><div><p>a</p><p/></div></section>",
    "<div/>",
])
def test_densities_follow_the_formula(inner):
    source = f"<body>{inner}</body>"
    page = htmltext.Page(source)
    page.marks()
    density, _, total = page.densities()
    want = by_definition(source)
    assert len(density) == len(want) + 1
    for node, (one, both) in enumerate(want, 1):
        assert density[node] == pytest.approx(one) and total[node] == pytest.approx(both)


PAGES = {
    "labelled boxes": (f'<div class="top">Site name</div><div class="menu">{LINKS}</div><div class="content"><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{MORE}</p></div><div class="side"><p>Weather today is fine.</p></div><div class="foot">Copyright</div>', f"Title\n{LONG}\nShort.\n{MORE}"),
    "no names at all": (f"<div>{LINKS}</div><div>{LONG}<br><br>{MORE} <b>bold</b> and</div><div>Copyright</div>", f"{LONG} {MORE} bold and"),
    "title outside": (f"<div><h1>Site</h1><div><h1>Title</h1><div><p>{LONG}</p><p>{MORE}</p><p>{LONG}</p></div></div><div><p>Buy our new thing today</p></div></div>", f"Title\n{LONG}\n{MORE}\n{LONG}"),
    "sections": (f'<div><div class="sec"><h2>A</h2><p>{LONG}</p><p>{MORE}</p></div><div class="sec"><h2>B</h2><p>{MORE}</p><p>tiny</p></div><p>The end.</p></div><div>{LINKS}</div>', f"A\n{LONG}\n{MORE}\nB\n{MORE}\ntiny\nThe end."),
    "many comments": (f'<div><p>{LONG}</p><p>{MORE}</p></div><div id="comments" class="comments-area"><ol class="comment-list">' + f'<li class="comment"><article class="comment-body"><p>{LONG}{MORE}</p></article></li>' * 9 + "</ol></div>", f"{LONG}\n{MORE}"),
    "comments within": (f'<article><h1>T</h1><p>{LONG}</p><div class="comments">' + f"<div><p>{MORE}{LONG}</p></div>" * 9 + "</div></article>", f"T\n{LONG}"),
    "layout table": (f'<table><tr><td class="menu">{LINKS}</td><td><p>{LONG}</p><p>{MORE}</p></td></tr></table>', f"{LONG}\n{MORE}"),
    "all in body": (f"<h1>T</h1><p>{LONG}</p><p>tiny</p><ul><li>one</li><li>two</li></ul>", f"T\n{LONG}\ntiny\none\ntwo"),
    "one paragraph": (f'<div class="ad">Buy now and save a lot of money on all of our things this very day.</div><div><h1>T</h1><p>{LONG}</p></div>', f"T\n{LONG}"),
    "article header": (f'<header><h1>Site</h1></header><div class="post"><header><h1>Title</h1></header><p>{LONG}</p><p>{MORE}</p></div>', f"Title\n{LONG}\n{MORE}"),
    "named by its subject": (f'<div class="menu">{LINKS}</div><div class="social-science"><h2>T</h2><p>{LONG}</p></div>', f"T\n{LONG}"),
    "named as a menu but the only text": (f'<div class="search"><p>{LONG}</p><p>{MORE}</p></div>', f"{LONG}\n{MORE}"),
    "related work": (f'<article><h1>T</h1><p>{LONG}</p><div class="related-work"><p>{MORE}</p></div><div class="related-posts"><p>Other things you may read here</p></div></article>', f"T\n{LONG}\n{MORE}"),
    "links of an article": (f"<article><p>{LONG}</p><ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul></article>", f"{LONG}\none\ntwo\nthree"),
}


@pytest.mark.parametrize("name", ["discussion", "social-post", "reply", "promotion", "alerts", "notice", "widget", "responses"])
def test_sections_with_names_that_tell_little(name):
    """A section of an article stays whatever its name; a notice, a thread of items or a box of links of that name goes."""
    whole = f"T\n{LONG}\nD\n{MORE}"
    for attribute in ("id", "class"):
        box = lambda inner: f'<article><h1>T</h1><p>{LONG}</p><section {attribute}="{name}">{inner}</section></article>'  # noqa: E731, B023
        assert htmltext.main_text(box(f"<h2>D</h2><p>{MORE}</p>")) == whole
        assert htmltext.main_text(box(f"<p>{MORE}</p><p>{LONG}</p>")) == f"T\n{LONG}\n{MORE}\n{LONG}"
        for other in ("<p>We have moved.</p>", f"<h2>D</h2><ul><li><p>{MORE}</p></li><li><p>{LONG}</p></li></ul>", f'<h2>D</h2><p><a href="1">{MORE}</a></p>', f"<h2>D</h2><p>{MORE}</p><form><input></form>"):
            assert htmltext.main_text(box(other)) == f"T\n{LONG}"


def test_formulas_stay_in_their_sentences():
    page = f"<article><p>{LONG}</p><p>So <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> &lt; 3 holds.</p></article>"
    assert htmltext.main_text(page) == f"{LONG}\nSo x+1 < 3 holds."


@pytest.mark.parametrize("n", [2, 3, 12])
def test_references_stay(n):
    links = "".join(f'<li><a href="{k}">Source {k}</a></li>' for k in range(n))
    page = "<body><div>{menu}</div><div><h1>T</h1><p>{text}</p><p>{more}</p><h2><span>References</span></h2><ul>{links}</ul></div></body>"
    found = htmltext.main_text(page.format(menu=LINKS, text=LONG, more=MORE, links=links))
    assert found == "\n".join(["T", LONG, MORE, "References", *[f"Source {k}" for k in range(n)]])


def longest_sum(page):
    """The choice of the core by brute force: every container that may hold the main text, the one with the largest sum."""
    page.marks()
    density, _, total = page.densities()
    able = []
    for node in range(len(page.tag)):
        up, good = node, not page.gone[node]
        while up >= 0:
            good, up = good and page.tag[up] in htmltext.CONTAINER, page.parent[up]
        if good:
            able.append(node)
    return max(able, key=lambda k: (total[k], page.tag[k] in htmltext.CORE, k)), density, total


@pytest.mark.parametrize("seed", range(40))
def test_the_core_is_that_of_brute_force(seed):
    """On random trees: no container has a larger sum, and the core's own paragraphs are in the text."""
    import random

    rng = random.Random(seed)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{' '.join(rng.choice(LONG.split()) for _ in range(rng.randint(1, 40)))}</p>" if rng.random() < 0.7 else f"<p>{LINKS}</p>"
        return "<div>" + "".join(tree(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    source = f"<html><body>{''.join(tree(4) for _ in range(3))}</body></html>"
    core, density, total = longest_sum(htmltext.Page(source))
    page = htmltext.Page(source)
    keep = page.chosen()
    inside = [k for k in range(len(page.tag)) if page.parent[k] == core and page.tag[k] == "p" and density[k] >= htmltext.MOST * max(density)]
    assert total[core] == max(t for k, t in enumerate(total) if page.tag[k] in htmltext.CONTAINER) and all(keep[k] for k in inside)


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    body, want = PAGES[name]
    assert htmltext.main_text(f"<html><head><title>x</title></head><body>{body}</body></html>") == want


def test_density_decides(monkeypatch):
    """With equal densities the adverts and menus of the pages come along."""
    real = htmltext.Page.densities

    def flat(self):
        real(self)
        n = len(self.tag)
        return [1.0] * n, [1.0] * n, [float(self.parent.count(k)) for k in range(n)]

    monkeypatch.setattr(htmltext.Page, "densities", flat)
    assert sum(htmltext.main_text(f"<body>{body}</body>") != want for body, want in PAGES.values()) > len(PAGES) / 2


@pytest.mark.parametrize("source", [
    "<body><p>x" + "<span>" * 20000 + "</b>" * 20000, "<b><div>" + "<span>" * 20000 + "</b>" * 20000, "<body>" + '<header><div class="ad">x' * 20000,
    '<a ="' * 20000 + "<a ='" * 20000, "<ul>" + "<li>" * 30000 + "</p>" * 30000, "<!--" * 50000, "<p>" + "&amp" * 50000,
])
def test_malformed_pages_take_time_in_proportion(source):
    began = time.process_time()
    htmltext.main_text(source)
    assert time.process_time() - began < 5


def test_names():
    for name in ("ad", "ad-banner", "cookie-notice", "sidebar-right", "share-buttons", "related-posts", "site-footer", "comment-list", "sideBar", "ads2", "user_comments"):
        assert htmltext.hinted(name) == (True, False), name
    for name in ("related-work", "social-science", "search-algorithms", "has-sidebar", "no-sidebar", "content-sidebar-wrap", "comments-open", "shared", "entry-header", ""):
        assert htmltext.hinted(name) == (False, False), name
    assert htmltext.hinted("site-header") == (False, True)


def test_tables_of_pages(spark):
    """Empty tables, nulls, repeated rows and columns with names of the output."""
    schema = "page_id long, url string, html string, text string, __html string, n_chars int"
    assert htmltext.extract(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", f"<p>{LONG}</p>", "t", "h", 1)] * 2 + [(None, None, None, None, None, None), (2, "v", "", "t", "h", 2)]
    found = sorted((tuple(r) for r in htmltext.extract(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert found == sorted([(1, "u", LONG)] * 2 + [(None, None, ""), (2, "v", "")], key=str)
