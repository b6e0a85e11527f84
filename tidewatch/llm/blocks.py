"""Leaf blocks of an HTML page: text between block borders, with what stands around it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

# Fixed values of HTML: elements without an end, inside a line, without readable text, all that can stand around a text, and those
# ended by their like.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
SILENT = set("script style template svg iframe object noframes".split())
ELEMENTS = set(
    "a abbr acronym address article aside audio b bdi bdo big blockquote body button canvas caption center cite code colgroup data datalist dd del details dfn "
    "dialog dir div dl dt em fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup html i ins kbd label legend li "
    "main map mark menu meter nav noscript ol optgroup option output p picture pre progress q rp rt ruby s samp search section select slot small span strike "
    "strong sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video".split()
)
ENDED_BY_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# What class, id and role words say about a part of a page.
KINDS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs toc pager pagination tabs",
    "head": "header masthead topbar head branding logo",
    "foot": "footer foot colophon copyright contentinfo legal",
    "side": "sidebar aside side widget related recommended more complementary teaser",
    "ad": "ad ads adv advert advertisement adbox sponsor sponsored promo promotion banner",
    "notice": "cookie cookies consent gdpr notice alert popup modal newsletter subscribe message warning dialog overlay",
    "comment": "comment comments discussion reply replies respond disqus reviews",
    "form": "form search login signup register contact",
    "share": "share social tags tag meta byline author follow",
    "body": "content article post entry main story text body page",
}
KIND_OF = {word: kind for kind, words in KINDS.items() for word in words.split()}

# Where a comment, the name of a tag, its parts and its end lie.
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
TAG_PART = re.compile(r"[^>\"'=]*+(?:=\s*+)?")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    around: frozenset[str]
    tag: str
    link_chars: int
    features: list[str] = field(default_factory=list)


def _kinds(attributes: str) -> set[str]:
    found = set()
    for m in NAMES.finditer(attributes):
        for word in WORD.findall((m[1] or m[2] or m[3] or "").lower()):
            if word in KIND_OF:
                found.add("kind:" + KIND_OF[word])
    return found


@dataclass
class Tag:
    name: str
    closes: bool
    attributes: str


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """The place of the ``>`` that ends the tag whose name ended at ``at``, -1 if the page ends first.

    A quote counts where a value begins. One that never closes is a character like any other; ``unclosed`` remembers those.
    """
    while True:
        part = TAG_PART.match(html, at)
        at = part.end()
        if at >= len(html):
            return -1
        if html[at] == ">":
            return at
        quote = html[at]
        if quote in "\"'" and part[0].rstrip().endswith("=") and quote not in unclosed:
            end = html.find(quote, at + 1)
            if end >= 0:
                at = end
            else:
                unclosed.add(quote)
        at += 1


def tokens(html: str) -> Iterator[str | Tag]:
    """Texts and tags in page order, without comments, declarations and silent elements; every character is looked at a bounded number of times.

    A tag, comment or silent element that the page ends in has no text, as browsers have it.
    """
    at, unclosed = 0, set()
    while at < len(html):
        start = html.find("<", at)
        if start < 0:
            start = len(html)
        if start > at:
            yield html[at:start]
        name = TAG_NAME.match(html, start + 1)
        if name:
            end = _tag_end(html, name.end(), unclosed)
            if end < 0:
                return
            tag = Tag(name[1].lower(), name[0][0] == "/", html[name.end() : end])
            at = end + 1
            if tag.name in SILENT and not tag.closes:
                close = re.compile(rf"</{tag.name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = html.find(">", close.end()) + 1 if close else 0
                if not at:
                    return
                continue
            yield tag
        elif html.startswith("<!--", start):
            at = html.find("-->", start + 4) + 3
            if at == 2:
                return
        elif html[start + 1 : start + 2] in ("!", "?", "/"):
            at = html.find(">", start) + 1
            if not at:
                return
        elif start < len(html):
            yield "<"
            at = start + 1
        else:
            return


class Open:
    """The open elements from the outermost one in, and for each name where in them it stands."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.at: dict[str, list[int]] = {}
        self.lines: list[int] = []

    def last(self, name: str) -> int:
        found = self.at.get(name)
        return found[-1] if found else -1

    def block(self) -> int:
        """The innermost element that is not inside a line."""
        return self.lines[-1] if self.lines else -1

    def push(self, name: str, attributes: str) -> None:
        above = self.stack[-1][1] if self.stack else frozenset()
        new = _kinds(attributes)
        if name in ELEMENTS:
            new.add("in:" + name)
        self.at.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.lines.append(len(self.stack))
        self.stack.append((name, above if new <= above else above | new))

    def end(self, name: str, border: int) -> None:
        """Ends the innermost ``name`` and all in it, if it stands within ``border``."""
        k = self.last(name)
        while k > border and len(self.stack) > k:
            gone = self.stack.pop()[0]
            self.at[gone].pop()
            if gone not in INLINE:
                self.lines.pop()


def blocks(html: str) -> list[Block]:
    """The non-empty leaf blocks in page order; white space is one space, references are decoded."""
    open_ = Open()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                around = open_.stack[-1][1] if open_.stack else frozenset()
                tag = open_.stack[open_.block()][0] if open_.block() >= 0 else ""
                out.append(Block(text, around, tag, linked))
            parts.clear()
        linked = 0

    for token in tokens(html):
        if isinstance(token, str):
            parts.append(token)
            if open_.last("a") >= 0:
                linked += len(token)
            continue
        tag = token.name
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if token.closes:
            open_.end(tag, open_.block() if inline else -1)
            continue
        if tag in VOID:
            continue
        if not inline and open_.last("p") == open_.block():
            open_.end("p", -1)
        if tag in ENDED_BY_LIKE:
            open_.end(tag, max(map(open_.last, ENDED_BY_LIKE[tag])))
        if token.attributes.endswith("/") and tag in ("path", "use"):
            continue
        open_.push(tag, token.attributes)
    flush()
    for b in out:
        b.features = _features(b)
    return out


def _features(b: Block) -> list[str]:
    words = b.text.count(" ") + 1
    share = min(1.0, b.link_chars / max(1, len(b.text)))
    out = ["any", "tag:" + b.tag, *b.around]
    out.append(f"words:{min(6, words.bit_length())}")
    out.append(f"links:{0 if share == 0 else 1 if share < 0.5 else 2}")
    out.append(f"ends:{b.text[-1] in '.!?…:;\"”»'}")
    if "©" in b.text:
        out.append("sign:copyright")
    if sum(c.isdigit() for c in b.text) * 4 > len(b.text):
        out.append("sign:digits")
    return out
