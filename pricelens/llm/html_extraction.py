"""Main text of web pages by the ratios of their tag paths.

A page is read into blocks: runs of text without the start or end of a block element between them. A block's
path is the chain of block elements above it, each with its class names; inline markup belongs to its block. Per path of a page, the text
length and the punctuation of its blocks are summed and divided by their number. The two ratios are fused into one value
per path, times a factor where an element names itself content. The values are smoothed along the
page by a Gaussian kernel among the blocks of one container, so a short line between paragraphs is carried by them. Paths whose mean
smoothed value falls under a share of the page's text-weighted mean are dropped; the blocks of the others are the text, with
the headings that stand before one of them in its container.

What names itself no content (menus, headers, footers, sidebars, notices, adverts, forms, reader comments) and
what is never shown (scripts, styles, hidden elements) takes no part. A class or id says nothing where a ``main`` or an ``article`` with
the page's main heading is inside it. Of a header within an article only the headings stay.

Defined cases: null and empty html give an empty text; html without tags is one block; elements that are never closed end where
a browser would end them; unknown references stay as they stand; repeated rows and repeated or null page ids are rows like others; a page
is read whole, whatever its length; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import exp

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by what they mean for the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style template noscript head title svg math iframe object video audio canvas select textarea button datalist dialog map".split()
)
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("body html li dd dt caption td th tr tbody thead tfoot legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Starting the first ends an open one of the second, up to an element of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
OUTSIDE = frozenset("nav footer aside form menu header".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert alertdialog dialog note".split())
OUTSIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner popup modal overlay notice notices "
    "cookie cookies consent gdpr alert nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer "
    "sidebar aside widget widgets related recommended recommendations trending popular share sharing social login signup signin search newsletter "
    "subscribe subscription comment comments respond reply replies disqus copyright".split()
)
INSIDE_WORDS = frozenset("article content main post entry story".split())
NOT_NAMING = frozenset("no has with without hide hidden".split())

#: Elements whose text runs to their end tag, whatever stands in it.
RAW = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*+>?", re.I) for x in "script style title textarea iframe noscript".split()}
#: A comment, a tag (quotes count only after =), or a declaration. Possessive, so a page is read in one linear pass.
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?--!?>|.*+)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/=]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+)(?:>|\Z)|<[!?/][^>]*+>?""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Factor of paths inside what names itself content, the kernel by distance, and the share of the mean that a path must reach,
#: elsewhere and inside content, where only bare links and the like fall under it.
CONTENT_FACTOR, RADIUS, SIGMA, SHARE, CONTENT_SHARE = 4.0, 2, 1.0, 0.3, 0.03
KERNEL = [exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(RADIUS + 1)]


class _Element:
    """A block element: what it says of itself, and, once the page is read, what holds for the blocks in it."""

    __slots__ = ("name", "step", "parent", "out", "named_out", "content", "cleared", "path", "header", "heading")

    def __init__(self, name: str, step: str, parent: _Element | None, out: bool, named_out: bool, content: bool):
        self.name, self.step, self.parent, self.out, self.named_out, self.content = name, step, parent, out, named_out, content
        self.cleared = False


@lru_cache(4096)
def _says(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Of a start tag: its step of the path, whether it is out by what it is, out by its names, content."""
    attrs: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        attrs.setdefault(name.lower(), unescape("".join(values)))
    found = WORDS.findall(CAMEL.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}").lower())
    words = {w for before, w in zip(["", *found], found) if before not in NOT_NAMING}
    role = attrs.get("role", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    named_out = not OUTSIDE_WORDS.isdisjoint(words) or role in OUTSIDE_ROLES
    content = tag in ("article", "main") or role in ("main", "article") or not INSIDE_WORDS.isdisjoint(words) or attrs.get("itemprop") == "articleBody"
    return ".".join([tag, *sorted(words)]), hidden or tag in OUTSIDE, named_out, content


class Blocks:
    """The blocks of a page in order: (text pieces, pieces inside links, element)."""

    def __init__(self, html: str):
        self.elements = [_Element("body", "body", None, False, False, False)]
        self.open = self.elements[:]
        #: How many open elements have a name.
        self.named = Counter[str]()
        self.unseen: list[str] = []
        self.blocks: list[tuple[list[str], list[str], _Element]] = []
        self.pieces: list[str] = []
        self.links: list[str] = []
        self.in_link = False
        at = 0
        while (token := TOKEN.search(html, at)) is not None:
            self.text(html[at : token.start()])
            at = token.end()
            if name := token[2]:
                name = name.lower()
                if token[1]:
                    self.end(name)
                else:
                    self.start(name, token[3])
                    if name in RAW:
                        last = RAW[name].search(html, at)
                        at = last.end() if last else len(html)
        self.text(html[at:])
        self.end_block()
        self.settle()

    def settle(self) -> None:
        """From the outer elements inwards: number of the path, and what holds inside."""
        paths: dict[tuple[int, str], int] = {}
        for e in self.elements:
            up = e.parent
            e.path = paths.setdefault((up.path if up else -1, e.step), len(paths))
            e.out = e.out and e.name != "header" or e.named_out and not e.cleared or bool(up and up.out)
            e.content = e.content or bool(up and up.content)
            e.header = e.name == "header" or bool(up and up.header)
            e.heading = e.name in HEADINGS or bool(up and up.heading)

    def end_block(self) -> None:
        if self.pieces:
            self.blocks.append((self.pieces, self.links, self.open[-1]))
            self.pieces, self.links = [], []

    def close_to(self, names: tuple[str, ...], barriers: frozenset[str] | tuple[str, ...]) -> None:
        if not any(self.named[n] for n in names):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k].name
            if name in names:
                self.end_block()
                self.named.subtract(e.name for e in self.open[k:])
                del self.open[k:]
                return
            if name in barriers:
                return

    def start(self, tag: str, attributes: str) -> None:
        if self.unseen:
            if tag != "body":
                self.unseen += [tag] * (tag == self.unseen[-1] and tag not in RAW)
                return
            self.unseen.clear()
        if tag in UNSEEN:
            self.unseen += [tag] * (tag not in RAW)
            return
        if tag == "br" and self.pieces:
            self.pieces.append(" ")
        if tag in ENDS_P:
            self.close_to(("p",), ("td", "th", "caption", "table", "li"))
        if tag in ENDS:
            self.close_to(*ENDS[tag])
        if tag in BLOCK:
            self.end_block()
        if tag in VOID or tag in ("html", "body"):
            return
        if tag == "a":
            self.in_link = True
        elif tag in BLOCK:
            self.push(_Element(tag, *(said := _says(tag, attributes))[:1], self.open[-1], *said[1:]))
        elif attributes and any(_says(tag, attributes)[1:3]):
            self.unseen.append(tag)

    def push(self, element: _Element) -> None:
        self.elements.append(element)
        self.open.append(element)
        self.named[element.name] += 1
        if element.name == "main":
            self.clear(element.parent)
        elif element.name == "h1" and self.named["article"]:
            self.clear(next(e.parent for e in reversed(self.open) if e.name == "article"))

    def clear(self, element: _Element | None) -> None:
        """Names of the elements around the main text say nothing."""
        while element is not None and not element.cleared:
            element.cleared = True
            element = element.parent

    def end(self, tag: str) -> None:
        if self.unseen:
            if tag == self.unseen[-1]:
                self.unseen.pop()
            return
        if tag == "a":
            self.in_link = False
        if tag in BLOCK:
            self.end_block()
            self.close_to((tag,), ())
        else:
            self.close_to((tag,), BLOCK)

    def text(self, data: str) -> None:
        if data and not self.unseen and (self.pieces or not data.isspace()):
            data = unescape(data) if "&" in data else data
            self.pieces.append(data)
            if self.in_link:
                self.links.append(data)


def _values(blocks: list[tuple[str, int, _Element]]) -> list[float]:
    """Per block of (text, link length, element) the fused ratios of its path, smoothed among its neighbours in one container."""
    sums: dict[int, list[float]] = {}
    for text, linked, e in blocks:
        s = sums.setdefault(e.path, [0, 0, 0, CONTENT_FACTOR if e.content else 1.0])
        s[0] += 1
        s[1] += max(len(text) - linked, 0)
        s[2] += len(PUNCTUATION.findall(text))
    fused = {path: factor * ((length / n) * (1 + marks / n)) ** 0.5 for path, (n, length, marks, factor) in sums.items()}
    smooth = []
    for i, (_, _, e) in enumerate(blocks):
        near = range(max(0, i - RADIUS), min(len(blocks), i + RADIUS + 1))
        pairs = [(KERNEL[abs(k - i)], fused[blocks[k][2].path]) for k in near if blocks[k][2].parent is e.parent or k == i]
        smooth.append(sum(w * v for w, v in pairs) / sum(w for w, _ in pairs))
    return smooth


def main_text(html: str | None) -> str:
    """The text of the content blocks, one line each."""
    if not html:
        return ""
    shown = []
    for pieces, links, e in Blocks(html).blocks:
        text = " ".join("".join(pieces).split())
        if text and not e.out and not (e.header and not (e.heading and e.content)):
            shown.append((text, sum(map(len, links)), e))
    if not shown:
        return ""
    values = _values(shown)
    mean = sum(v * len(b[0]) for v, b in zip(values, shown)) / sum(len(b[0]) for b in shown)
    by_path: dict[int, list[float]] = {}
    for value, (_, _, e) in zip(values, shown):
        by_path.setdefault(e.path, [CONTENT_SHARE if e.content else SHARE]).append(value)
    able = {path for path, (share, *v) in by_path.items() if sum(v) / len(v) >= share * mean}
    kept = [e.path in able for _, _, e in shown]
    for i in range(len(shown) - 2, -1, -1):
        e, after = shown[i][2], shown[i + 1][2]
        kept[i] |= kept[i + 1] and e.heading and (e.parent is after.parent or e.header)
    return "\n".join(text for (text, _, _), k in zip(shown, kept) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column("html")]
        lengths = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    narrow = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema if f.name != "html")
    return narrow.mapInArrow(_extract, f"{kinds}, text string, n_chars long")


#: The given pages mark their text by one article of headings and paragraphs; SQL can cut that out.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h1)>'), lambda s:
        trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(s, '<br>', ' ', 'g'), '</?b>', '', 'g'),
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS t FROM a)
SELECT page_id, url, array_to_string(list_filter(t, lambda s: s <> ''), chr(10)) AS text,
       CAST(length(array_to_string(list_filter(t, lambda s: s <> ''), chr(10))) AS BIGINT) AS n_chars
FROM b
"""
