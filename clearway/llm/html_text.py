"""Main text of web pages by composite text density.

Every block element is scored by its characters per tag, lowered where much of its text is link text. The element
whose children have the largest sum of densities is the content; blocks beside it are content too where they
are at least as dense as the thinnest element between it and the body. Text markup (bold, links, line breaks) is no
element of its own here: it only counts as tags and link characters of the block that holds it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clearway.llm.common import by_row

# HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
NEVER_TEXT = frozenset(
    "head script style noscript template iframe object svg canvas audio video map nav aside footer button select textarea input "
    "option dialog menu".split()
)
# A header or footer inside an article is a part of it only if it is a header.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
SAME_KIND = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Words in class, id or role that name page furniture, and words that only say which or where.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion nav navbar navigation menu menus menubar breadcrumb "
    "breadcrumbs header masthead topbar footer sidebar sidebars aside complementary contentinfo notice notices cookie cookies consent gdpr banner alert popup "
    "modal overlay comment comments commentlist discussion disqus replies reply respond reactions form login signup subscribe subscription newsletter search "
    "share sharing social related recommended recommendations widget widgets toolbar pagination pager skip".split()
)
PLACES = frozenset("area bar block box container group item items left link links list page posts right section site top wrap wrapper".split())
# Of the furniture, what names remarks of readers; and parts of such names.
REMARKS = frozenset("comment comments commentlist discussion disqus replies reply respond reactions".split())
REMARK_PARTS = PLACES | frozenset("author body children content count even odd depth form head header footer inner main meta new old text thread title".split())
# Elements whose content is text up to their end tag, and those of them that may hold character references.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset("title textarea".split())
NAMES = frozenset("class id role itemprop".split())
_TOKENS, _WORDS = re.compile(r"[^\s]+"), re.compile(r"[a-z]+")
_TAG_NAME = re.compile(r"[^\s/>]+")
_BETWEEN, _SPACE = re.compile(r"[\s/]*"), re.compile(r"\s*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_UNQUOTED = re.compile(r"[^\s>]*")
Attributes = list[tuple[str, str]]


def tokens(html: str) -> Iterator[tuple[str, str, Attributes]]:
    """("text", text, []), ("start", name, attributes) and ("end", name, []) in page order.

    Every character is looked at a bounded number of times: what is opened and never closed (a comment, a tag, a quoted value, a script) takes
    the rest of the page, as in browsers. Comments, declarations and processing instructions are left out.
    """
    at, size = 0, len(html)
    while at < size:
        less = html.find("<", at)
        if less < 0:
            yield "text", unescape(html[at:]), []
            return
        if less > at:
            yield "text", unescape(html[at:less]), []
        at = less + 1
        char = html[at:at + 1]
        if char.isascii() and char.isalpha():
            name = _TAG_NAME.match(html, at)
            read = _attributes(html, name.end())
            if read is None:
                return
            at, attributes = read
            tag = name[0].lower()
            yield "start", tag, attributes
            if tag in RAW or tag in RAW_WITH_REFERENCES:
                end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(html, at)
                stop = end.start() if end else size
                if stop > at:
                    yield "text", unescape(html[at:stop]) if tag in RAW_WITH_REFERENCES else html[at:stop], []
                at = stop
        elif char == "/" and html[at + 1:at + 2].isascii() and html[at + 1:at + 2].isalpha():
            name = _TAG_NAME.match(html, at + 1)
            read = _attributes(html, name.end())
            if read is None:
                return
            at = read[0]
            yield "end", name[0].lower(), []
        elif html.startswith("!--", at):
            # "<!-->" and "<!--->" are whole comments.
            end = html.find("-->", at + 1)
            if end < 0:
                return
            at = end + 3
        elif char and char in "!?/":
            end = html.find(">", at)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<", []


def _attributes(html: str, at: int) -> tuple[int, Attributes] | None:
    """Where a tag ends, and its attributes from ``at`` on; None if it has no end."""
    found: Attributes = []
    while True:
        at = _BETWEEN.match(html, at).end()
        if at >= len(html):
            return None
        if html[at] == ">":
            return at + 1, found
        name = _ATTRIBUTE.match(html, at)
        at, value = name.end(), ""
        after = _SPACE.match(html, at).end()
        if html[after:after + 1] == "=":
            at = _SPACE.match(html, after + 1).end()
            quote = html[at:at + 1]
            if quote and quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1:end], end + 1
            else:
                value = _UNQUOTED.match(html, at)[0]
                at += len(value)
        found.append((name[0].lower(), unescape(value)))


class Element:
    __slots__ = ("tag", "parent", "items", "own", "tags", "link_tags", "furniture", "suspect", "remarks", "chars", "link_chars", "density", "total")

    def __init__(self, tag: str, parent: Element | None, furniture: bool = False, suspect: bool = False, remarks: bool = False):
        self.tag, self.parent, self.furniture, self.suspect, self.remarks = tag, parent, furniture, suspect, remarks
        # Own text markup, links and their characters, before measuring.
        self.own: tuple[int, int, int] | None = None
        self.items: list[Element | str] = []
        # Own text markup and links; the numbers of whole subtrees once measured.
        self.tags = self.link_tags = self.chars = self.link_chars = 0
        self.density = self.total = 0.0


def is_furniture(tag: str, attrs: Attributes, in_article: bool) -> bool:
    """Elements that hold no text of the page by their kind, or hidden ones."""
    return tag in NEVER_TEXT or (tag == "header" and not in_article) or any(name == "hidden" for name, _ in attrs)


def names_of(attrs: Attributes) -> Iterator[list[str]]:
    """The words of each token of class, id and role."""
    for name, value in attrs:
        if name in NAMES and value:
            for token in _TOKENS.findall(value.lower()):
                yield _WORDS.findall(token)


def is_remarks(tag: str, attrs: Attributes) -> bool:
    """Elements named as remarks of readers: a token of such words and parts of such names only ("comment-list", not "has-comments")."""
    return tag not in ("body", "html", "main") and any(
        any(w in REMARKS for w in words) and all(w in REMARKS or w in REMARK_PARTS for w in words) for words in names_of(attrs))


def is_suspect(tag: str, attrs: Attributes, in_article: bool) -> bool:
    """Forms, and elements whose class, id or role has a token of furniture words only; they go if they hold little (``_settle``)."""
    if tag in ("body", "html", "article", "main"):
        return False
    if tag == "form":
        return True
    for words in names_of(attrs):
        # "article-header" names the header of the article, "page-header" that of the page.
        named = any(w in FURNITURE for w in words) and all(w in FURNITURE or w in PLACES for w in words)
        if named and not (in_article and words[-1] == "header" and tag in ("header", "div")):
            return True
    return False


class Builder:
    """A forgiving tree of block elements: unclosed and stray tags end where HTML would end them."""

    def __init__(self):
        self.root = self.at = Element("body", None)
        # The open elements, outermost first, and the places of each kind among them.
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.links = 0

    def read(self, html: str) -> Element:
        for kind, value, attributes in tokens(html):
            if kind == "text":
                self.text(value)
            elif kind == "start":
                self.start(value, attributes)
            else:
                self.end(value)
        return self.root

    def start(self, tag: str, attrs: Attributes) -> None:
        if tag in ("html", "body"):
            return
        in_article = bool(self.places.get("article"))
        if tag in INLINE:
            self.at.tags += 1
            if tag == "a":
                self.at.link_tags += 1
                self.links = 1
            elif tag == "br":
                self.at.items.append(" ")
            # Inside running text only what is hidden goes.
            if tag not in VOID and is_furniture(tag, attrs, in_article):
                self._open(Element(tag, self.at, True))
            return
        if tag in CLOSES_P:
            self._close("p", ("td", "th", "article", "li"))
        if tag in SAME_KIND:
            for kind in ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,):
                self._close(kind, SAME_KIND[tag])
        if tag in VOID:
            self.at.tags += 1
            self.at.items.append(" ")
            return
        self._open(Element(tag, self.at, is_furniture(tag, attrs, in_article), is_suspect(tag, attrs, in_article), is_remarks(tag, attrs)))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag not in VOID:
            self._close(tag, ("td", "th", "article", "li") if tag == "p" else ("p",) if tag in INLINE else ())

    def text(self, data: str) -> None:
        self.at.items.append(data)
        if self.links:
            self.at.link_chars += len(data) - data.count(" ")

    def _open(self, inner: Element) -> None:
        self.links = 0
        self.at.items.append(inner)
        self.at = inner
        self.places.setdefault(inner.tag, []).append(len(self.stack))
        self.stack.append(inner)

    def _close(self, tag: str, within: tuple[str, ...]) -> None:
        """End the innermost open ``tag``, unless one of ``within`` lies between."""
        places = self.places.get(tag)
        if not places or any(self.places.get(w) and self.places[w][-1] > places[-1] for w in within):
            return
        for e in reversed(self.stack[places[-1]:]):
            self.places[e.tag].pop()
            self.stack.pop()
        self.at = self.stack[-1] if self.stack else self.root


def _preorder(root: Element) -> list[Element]:
    """All elements that are not page furniture, parents first."""
    found, stack = [], [root]
    while stack:
        e = stack.pop()
        found.append(e)
        stack += [x for x in reversed(e.items) if isinstance(x, Element) and not x.furniture]
    return found


def _measure(elements: list[Element], body: Element) -> None:
    for e in reversed(elements):
        if e.own is None:
            e.own = e.tags, e.link_tags, e.link_chars
        e.tags, e.link_tags, e.link_chars = e.own
        e.density = 0.0
        e.chars = sum(len(x) - x.count(" ") for x in e.items if isinstance(x, str))
        e.tags += 1
        for x in e.items:
            if isinstance(x, Element) and not x.furniture:
                e.chars += x.chars
                e.tags += x.tags
                e.link_chars += x.link_chars
                e.link_tags += x.link_tags
    share = body.link_chars / max(1, body.chars)
    for e in elements:
        if e.chars:
            other = max(1, e.chars - e.link_chars)
            base = math.log(e.chars / other * e.link_chars + share * e.chars + math.e)
            weight = e.chars / max(1, e.link_chars) * (e.tags / max(1, e.link_tags))
            e.density = e.chars / e.tags * max(0.0, math.log(max(weight, 1.0))) / base
    for e in elements:
        e.total = sum(x.density for x in e.items if isinstance(x, Element) and not x.furniture)


def _path(e: Element) -> list[Element]:
    path = [e]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    return path


def _densest(elements: list[Element], body: Element) -> Element:
    _measure(elements, body)
    best = max(elements, key=lambda e: e.total)  # the outermost of equals, as parents come first
    return best if best.total else body


def _drop_remarks(elements: list[Element]) -> bool:
    """Mark remarks of readers as furniture, whatever their size.

    A container named so is only a wrapper of the page if it holds the page's main, or the only article, and no other stands outside of remarks.
    """
    inside: set[int] = set()
    for e in elements:
        if e.remarks or (e.parent is not None and id(e.parent) in inside):
            inside.add(id(e))
    marks = [e for e in elements if e.tag == "main" or (e.tag == "article" and not e.remarks)]
    kept: set[int] = set()
    if all(id(e) in inside for e in marks):
        mains = [e for e in marks if e.tag == "main"]
        for e in mains or (marks if len(marks) == 1 else []):
            while e is not None and id(e) not in kept:
                kept.add(id(e))
                e = e.parent
    gone = [e for e in elements if e.remarks and id(e) not in kept]
    for e in gone:
        e.furniture = True
    return bool(gone)


def _settle(elements: list[Element], body: Element) -> bool:
    """Mark suspects as furniture, but for those around the densest subtree, an article or a main.

    On a page without article and main, those with over half of the text stay too.
    """
    best = _densest(elements, body)
    kept = set(map(id, _path(best)))
    marks = [e for e in elements if e.tag in ("article", "main") and e.chars]
    for e in marks:
        while e is not None and id(e) not in kept:
            kept.add(id(e))
            e = e.parent
    gone = [e for e in elements if e.suspect and id(e) not in kept and (marks or 2 * e.chars <= body.chars)]
    for e in gone:
        e.furniture = True
    return bool(gone)


def _content(body: Element) -> list[Element]:
    elements = _preorder(body)
    if _drop_remarks(elements):
        elements = _preorder(body)
    if any(e.suspect for e in elements) and _settle(elements, body):
        elements = _preorder(body)
    best = _densest(elements, body)
    # A sum that comes from one article or main alone stands for that.
    dense = [x for x in best.items if isinstance(x, Element) and not x.furniture and x.density]
    if len(dense) == 1 and dense[0].tag in ("article", "main"):
        best = dense[0]
    path = _path(best)
    # The page's own mark of its article widens a best element that lies inside it.
    marked = [e for e in path if e.tag == "article"][-1:] or [e for e in path if e.tag == "main"][-1:]
    if marked:
        return marked
    threshold = min(e.density for e in path)
    inside = set(map(id, path))
    chosen, stack = [], [body]
    while stack:
        e = stack.pop()
        if e is best or (id(e) not in inside and e.density >= threshold and e.chars):
            chosen.append(e)
        elif id(e) in inside:
            stack += [x for x in reversed(e.items) if isinstance(x, Element) and not x.furniture]
    return chosen


def _blocks(root: Element) -> list[str]:
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        if line := " ".join("".join(run).split()):
            blocks.append(line)
        run.clear()

    stack: list[Element | str | None] = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            flush()
        elif not x.furniture:
            flush()
            stack.append(None)
            stack += reversed(x.items)
        elif x.tag not in INLINE:
            flush()
    flush()
    return blocks


def main_text(html: str | None) -> str:
    """The blocks of the main content, one a line; empty if there is none."""
    if not html:
        return ""
    return "\n".join(line for e in _content(Builder().read(html)) for line in _blocks(e))


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page; null or empty html gives an empty text. One row per input row."""

    def one(page_id, url, html):
        text = main_text(html)
        return page_id, url, text, len(text)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(by_row(one, ["id", "url", "html"], EXTRACTED), "page_id long, url string, text string, n_chars long")
