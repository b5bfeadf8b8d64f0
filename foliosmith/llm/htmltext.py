"""Main text of HTML pages by composite text density.

A page is read into a DOM (flat lists in page order, so nesting depth costs nothing).  What can't be main text by the meaning of its element
goes first: scripts, styles, navigation, footers, asides, controls, hidden elements, page headers, and forms and elements with such a role (these two
unless they hold an article, a main element or an h1).  For each other node with C characters, T tags, L link characters and K link tags
(a zero counts as 1), over a body with C_b and L_b,

    density = C / T * log(C / L * T / K) / log(1 + log(C / (C - L) * L + L_b / C_b * C + e))

An element whose class or id names it an advert, menu, notice, comment list and the like is no more than a weight: ``HINT`` of its characters and
all its tags count as those of links.  A node's sum is the density of its children and of its own text, taken as a leaf.

1. The container of the largest sum (of equal ones the article or main element, then the inner one) is the core.  While one container in it
   holds nearly all of its sum, the core moves down into that.
2. The path from body to the core gives the thresholds.  On the way up, another container beside the path joins if its density reaches the least
   density of the path below; where it is the same element as the path's, the least of the whole path is enough (``ALIKE`` of it where their class is the same too),
   and in one article or main element with it, any density is.  Paragraphs, lists and headings beside the path join together with such a container, or where one of them reaches that threshold, or
   in an article or main element; an h1 or h2 before the path joins where the core has none.
3. In what has joined, named elements below the least density of the path go, as do lists and boxes of nothing but three or more links; all else stays.

Text: character references decoded, white space inside a block one space, blocks in page order joined by a newline.
Defined results: null or empty pages and pages without text give an empty text; repeated rows are each
answered; an empty input gives an empty output; extra columns are ignored.  Work is in proportion to the page, however it is nested or malformed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .storage import frugal

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr caption ul".split())
SPACED = {"br", "td", "th", "img"}
NEVER = RAW | set("annotation annotation-xml head nav footer aside form button select input menu dialog object audio video canvas map search".split())
CORE = {"article", "main"}
HEADING = set("h1 h2 h3 h4 h5 h6".split())
TITLES = {"h1", "h2"}
# An open element is closed by these starts, looking up to its own kind of container.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = BLOCK - {"p", "address"} | {"td", "th", "button", "object"}
CONTAINER = set("#root html body div section article main center table tbody tr td form fieldset details".split())
LINKED = CONTAINER | {"ul", "ol", "dl"}

#: Share of the characters of a named element that count as link characters.
HINT = 0.9
#: The share of the path's least density that is enough for a container with the class of the path's.
ALIKE = 0.5
#: Characters that make a paragraph a long one.
LONG_PARAGRAPH = 60
#: The core moves into a container that holds this share of its sum.
MOST = 0.9

# Words of class names and ids.  A name is a hint if it has one of NAMED, alone or with digits, words of BEFORE before it and words of AFTER behind it.
NAMED = set("""ad ads adbox adsense advert adverts advertisement advertisements advertising advertorial banner banners sponsor sponsors sponsored promo promos promotion promotions sidebar sidebars
 menu menus menubar nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert alerts newsletter subscribe subscription popup popups modal overlay
 share sharing social related recommend recommended recommendation recommendations comment comments commentlist discussion disqus reply replies respond responses widget widgets toolbar
 pagination pager login signup signin search""".split())
# Words among them that sections of articles are named by too: alone they are a hint only where the element reads like no section.
DOUBTFUL = set("discussion social reply replies respond responses promotion promotions notice notices alert alerts widget widgets".split())
# Headings of lists of links that belong to a text.
SOURCES = set("references reference bibliography sources notes footnotes literature citations literatur quellen quellenangaben einzelnachweise références bibliographie referencias fuentes notas bibliografía".split()) | {"further reading", "external links", "see also", "works cited"}
TOPS = {"header", "masthead", "topbar"}
BEFORE_TOP = set("site global main top sticky mobile fixed".split())
BEFORE = set("site page main left right top bottom header footer user reader readers post article entry blog global primary secondary mobile desktop sticky fixed legal google media inline side the js".split())
AFTER = set("""box bar block blocks list lists wrapper wrap container area section panel inner outer left right top bottom item items group row column col link links button buttons icon icons form thread
 post posts article articles story stories news slot unit zone label title text content body holder count center layer module feed toggle large small head header area overlay media nav menu message""".split())
_BAR = re.compile(r"(?i)(side|top|nav|menu)[_-]?bar")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar"}
_TOKEN = re.compile(r"""<!--(?:>|->)|<!--.*?(?:--!?>|\Z)|<(?:[!?]|/[^a-zA-Z])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|=|["'])*)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def hinted(label: str, telling: set[str] = NAMED) -> tuple[bool, bool]:
    """Whether a class or id names an element that is no main text, by one of the ``telling`` words, and whether it names a page header."""
    named = top = False
    for name in label.split():
        words = [w.lower() for w in _SPLIT.findall(_BAR.sub(lambda m: m[1].lower() + "bar", name))]
        words = [w for w in words if not w.isdigit()]
        for at, word in enumerate(words):
            if (word in NAMED or word in TOPS) and all(w in NAMED or w in (BEFORE if word in NAMED else BEFORE_TOP) for w in words[:at]) and all(w in AFTER or w in NAMED for w in words[at + 1 :]):
                if word in telling:
                    named = True
                elif word in TOPS:
                    top = True
    return named, top


class Page:
    """A DOM: ``tag``, ``parent`` and ``attrs`` by node in page order; ``items`` are (node, text) and (node, None) for a block edge."""

    def __init__(self, source: str):
        self.tag, self.parent, self.attrs, self.items = ["#root"], [-1], [""], []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, end = [0], 0, len(source)
        tag, items = self.tag, self.items
        opened: dict[str, list[int]] = {}
        scopes: list[int] = []

        def text(lo: int, hi: int) -> None:
            if lo < hi:
                items.append((stack[-1], html.unescape(source[lo:hi])))

        def close(depth: int) -> None:
            while len(stack) > depth:
                name = tag[stack.pop()]
                opened[name].pop()
                if name in SCOPE:
                    scopes.pop()
                if name in BLOCK:
                    items.append((stack[-1], None))

        def deepest(names) -> int:
            return max((found[-1] for n in names if (found := opened.get(n))), default=0)

        def find(names, limits) -> int:
            """The depth of the innermost open element of these names that no limit lies in; 0 without one."""
            depth = deepest(names)
            bound = (scopes[-1] if scopes else 0) if limits is SCOPE else deepest(limits)
            return depth if depth >= bound else 0

        while at < end:
            found = _TOKEN.search(source, at)
            if not found:
                text(at, end)
                break
            text(at, found.start())
            at = found.end()
            name = (found[2] or "").lower()
            if not name or (not found[4] and at == end):
                continue
            if found[1]:
                if depth := find((name,), () if name in BLOCK else SCOPE):
                    close(depth)
                continue
            if name in BLOCK and (depth := find(("p",), SCOPE)):
                close(depth)
            if name in CLOSED_BY and (depth := find(*CLOSED_BY[name])):
                close(depth)
            if name in BLOCK:
                items.append((stack[-1], None))
            elif name in SPACED:
                items.append((stack[-1], " "))
            tag.append(name)
            self.parent.append(stack[-1])
            self.attrs.append(found[3] or "")
            if name in VOID:
                continue
            if name in RAW:
                ends = re.compile(rf"(?i)</{re.escape(name)}(?=[\s/>])[^>]*>?").search(source, at)
                at = ends.end() if ends else end
                continue
            if not (found[3] or "").rstrip().endswith("/") or name in BLOCK | {"a", "b", "i", "span"}:
                opened.setdefault(name, []).append(len(stack))
                if name in SCOPE:
                    scopes.append(len(stack))
                stack.append(len(tag) - 1)

    def marks(self) -> None:
        """Sets by node: ``gone`` (it or one around it can't be main text), ``header`` (a page header, gone too), ``hint`` (its name is of no main text), ``within`` (an article or main element) and ``kind`` (element and class)."""
        n = len(self.tag)
        flagged, named, tops, doubtful, self.kind = [False] * n, [False] * n, [False] * n, [], list(self.tag)
        for node in range(1, n):
            name, raw = self.tag[node], self.attrs[node]
            flagged[node] = name in NEVER
            if raw and not flagged[node]:
                attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
                self.kind[node] = f"{name}.{attrs.get('class', '')}"
                flagged[node] = "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
                if name not in ("html", "body"):
                    label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
                    named[node], tops[node] = hinted(label)
                    if named[node] and not hinted(label, NAMED - DOUBTFUL)[0]:
                        doubtful.append(node)
        self.within, self.header, self.hint, self.never, core, titled = ([False] * n for _ in range(6))
        for node in range(1, n):
            up = self.parent[node]
            self.within[node] = self.within[up] or self.tag[up] in CORE and not named[up]
        for node in self._sections(doubtful) if doubtful else ():
            named[node] = not self.within[node]
        for node in range(n - 1, 0, -1):
            name = self.tag[node]
            holds = core[node] or titled[node]
            self.never[node] = flagged[node] and (name in NEVER and name not in ("form", "dialog") or not holds)
            self.header[node] = name == "header" and not self.within[node] and not core[node]
            self.hint[node] = (named[node] or tops[node] and name not in HEADING and not self.within[node]) and not holds
            core[node] |= name in CORE and not named[node]
            titled[node] |= name == "h1"
            if not (self.never[node] or self.header[node]):
                core[self.parent[node]] |= core[node]
                titled[self.parent[node]] |= titled[node]
        self.gone = [a or b for a, b in zip(self.never, self.header)]
        for node in range(1, n):
            self.gone[node] |= self.gone[self.parent[node]]

    def _sections(self, nodes: list[int]) -> list[int]:
        """Those of the nodes that read like sections: a heading or several paragraphs, some of it long, hardly links, no form, and no list of items as of comments."""
        n = len(self.tag)
        own = [0] * n
        for node, text in self.items:
            own[node] += len("".join(text.split())) if text else 0
        chars, linked, long, heads, marks = list(own), [0] * n, [0] * n, [0] * n, [0] * n
        for node in range(n - 1, 0, -1):
            name, up = self.tag[node], self.parent[node]
            linked[node] = chars[node] if name == "a" else linked[node]
            long[node] += name == "p" and chars[node] >= LONG_PARAGRAPH
            heads[node] += name in HEADING
            marks[node] += 2 if name in ("form", "input", "textarea", "button", "select") else name in ("li", "article", "time")
            for counts in (chars, linked, long, heads, marks):
                counts[up] += counts[node]
        return [k for k in nodes if long[k] and (heads[k] or long[k] > 1) and marks[k] < 2 and linked[k] <= 0.2 * chars[k]]

    def densities(self) -> tuple[list[float], list[float], list[float]]:
        """Composite density of each node, of its own text as a leaf, and its sum."""
        n = len(self.tag)
        own, chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0.0] * n, [0] * n
        weight, in_hint = [0.0] * n, [False] * n
        for node in range(1, n):
            up = self.parent[node]
            in_hint[node] = in_hint[up] or self.hint[node]
            weight[node] = 1.0 if weight[up] == 1 or self.tag[node] == "a" else HINT if in_hint[node] else 0.0
        for node, text in self.items:
            if text and not self.gone[node]:
                own[node] += len("".join(text.split()))
        for node in range(n - 1, -1, -1):
            if self.gone[node]:
                continue
            chars[node] += own[node]
            linked[node] += weight[node] * own[node]
            if node:
                up = self.parent[node]
                chars[up] += chars[node]
                linked[up] += linked[node]
                tags[up] += tags[node] + 1
                links[up] += links[node] + (self.tag[node] == "a" or in_hint[node])
        self.chars, self.linked, self.links, self.in_hint = chars, linked, links, in_hint
        share = linked[0] / max(chars[0], 1)

        def composite(c: int, t: int, lc: float, lt: int) -> float:
            if not c:
                return 0.0
            inner = c / max(c - lc, 1) * lc + share * c + e
            return c / max(t, 1) * log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)) / log(log(inner) + 1.0)

        density = [composite(chars[k], tags[k], linked[k], links[k]) for k in range(n)]
        alone = [composite(own[k], 1, weight[k] * own[k], 0) for k in range(n)]
        total = list(alone)
        for node in range(1, n):
            total[self.parent[node]] += density[node]
        return density, alone, total

    def chosen(self) -> list[bool]:
        """Whether a node's own text belongs to the main text."""
        self.marks()
        n, tag = len(self.tag), self.tag
        density, alone, total = self.densities()
        box = [tag[k] in CONTAINER or "-" in tag[k] for k in range(n)]
        kids: list[list[int]] = [[] for _ in range(n)]
        last = list(range(n))
        for node in range(1, n):
            box[node] = box[node] and box[self.parent[node]] and not self.gone[node]
            if self.chars[node]:
                kids[self.parent[node]].append(node)
        for node in range(n - 1, 0, -1):
            last[self.parent[node]] = max(last[self.parent[node]], last[node])
        top = max((k for k in range(n) if box[k]), key=lambda k: (total[k], tag[k] in CORE, k))
        while inner := [k for k in kids[top] if box[k] and density[k] >= MOST * total[top] > 0]:
            top = inner[0]
        path = [top]
        while tag[path[-1]] != "body" and path[-1]:
            path.append(self.parent[path[-1]])
        least, below = min(density[k] for k in path), density[top]
        titled = any(tag[k] in TITLES and self.chars[k] for k in range(top, last[top] + 1))
        whole, own = [False] * n, [False] * n
        whole[top] = True
        for under, at in zip(path, path[1:]):
            sealed = self.within[under]
            others = [k for k in kids[at] if k != under]
            boxes = [k for k in others if box[k] and (sealed or density[k] >= below or self.kind[k] == self.kind[under] and density[k] >= least * (ALIKE if "." in self.kind[k] else 1))]
            plain = [k for k in others if not box[k]]
            if sealed or boxes or alone[at] >= below or any(density[k] >= below for k in plain):
                own[at] = True
                for k in boxes + plain:
                    whole[k] = True
                titled = titled or any(tag[k] in TITLES for k in plain)
            elif not titled:
                for k in [k for k in plain if tag[k] in TITLES and k < under][-1:]:
                    whole[k] = titled = True
            below = min(below, density[at])
        on_path, cited = set(path), self._cited()
        keep = [False] * n
        for node in range(n):
            up = self.parent[node]
            inside = node > 0 and keep[up] and (whole[up] or up not in on_path)
            keep[node] = whole[node] or own[node] or inside
            whole[node] = whole[node] or inside
            if self.never[node] or self.header[node] and (tag[up] in ("#root", "html", "body") or not whole[up]):
                keep[node] = whole[node] = False
            elif node not in on_path and keep[node]:
                if self.hint[node] and density[node] < density[top] and not self.in_hint[top]:
                    keep[node] = whole[node] = False
                elif tag[node] in LINKED and not self.within[node] and self.links[node] > 2 and self.linked[node] >= 0.98 * self.chars[node] > 0:
                    keep[node] = whole[node] = node in cited
        return keep

    def _cited(self) -> set[int]:
        """Nodes that stand right after a heading of references."""
        heading, said = [0] * len(self.tag), {}
        for node in range(1, len(self.tag)):
            heading[node] = node if self.tag[node] in HEADING else heading[self.parent[node]]
        for node, text in self.items:
            if text and heading[node]:
                said.setdefault(heading[node], []).append(text)
        heads = {k for k, parts in said.items() if " ".join("".join(parts).split()).strip(":.").lower() in SOURCES}
        found, before = set(), {}
        if heads:
            for node in range(1, len(self.tag)):
                up = self.parent[node]
                if before.get(up) in heads:
                    found.add(node)
                if self.chars[node]:
                    before[up] = node
        return found

    def text(self) -> str:
        keep = self.chosen()
        blocks, now = [], []
        for node, text in [*self.items, (0, None)]:
            if text is None:
                if now:
                    blocks.append(" ".join("".join(now).split()))
                    now = []
            elif keep[node]:
                now.append(text)
        return "\n".join(b for b in blocks if b)


def main_text(source: str | None) -> str:
    """The main text of one page."""
    return Page(source).text() if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, keep columns, text); narrow, no shuffle."""
    wanted = [id_col, *keep]
    shown = pages.select(*wanted, F.col(html_col).alias("__html"))
    schema = T.StructType([*pages.select(*wanted).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x.as_py()) for x in part.column(len(wanted))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(wanted)], pa.array(texts, pa.string())], names=[*wanted, "text"])

    return shown.mapInArrow(frugal(run), schema)
