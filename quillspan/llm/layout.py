"""Layout of a page: pieces, blocks and rendered text.

A tree builder with implied end tags and visibility rules turns a page into blocks (runs of inline
content between block boundaries); each knows its pieces, tag, link share and container. A page
without tags is plain text: each line is a block.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache
from operator import itemgetter

#: Cuts of a page: every tag (``<`` up to the next ``>``) and every line break.
CUT = re.compile(r"<[^>]*>|[\r\n]")
_TAG = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)")
#: HTML's elements by their role.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_HIDDEN = frozenset("script style head title template noscript select option textarea iframe object svg".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("li td th dt dd figcaption caption".split())
#: Of these, the element around them tells where a block stands.
_IN_CONTAINER = _CELLS | _HEADINGS | {"p"}
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
#: An element that opens ends open elements of these names, up to the nearest scope.
_IMPLIED = {
    "li": (("li", "p"), ("ul", "ol")), "dt": (("dt", "dd", "p"), ("dl",)), "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)), "td": (("td", "th", "p"), ("tr", "table")), "th": (("td", "th", "p"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_NOT_SHOWN = re.compile(r"\bhidden\b(?!=)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"[\r\n]")
_MARKS = frozenset("[]()|/·•>»«-–—&©#*+=_.,;:!?")


def tags_of(page: str) -> list[tuple[str, str, str]]:
    """(tag without its marks, ">", text up to the next tag) of each tag of a page, behind ("", "", text before the first one).

    The same cuts as those of ``CUT`` but for line breaks, which stay in the texts.
    """
    first, *parts = page.split("<")
    out = [("", "", first)]
    cuts = [x.partition(">") for x in parts]
    if all(map(itemgetter(1), cuts)):
        return out + cuts
    begun: list[str] = []
    for cut, end, text in cuts:
        begun.append(cut)
        if end:
            out.append(("<".join(begun), end, text))
            begun = []
    if begun:  # never closed, so it is text
        out[-1] = (*out[-1][:2], "<".join([out[-1][2], *begun]))
    return out


@lru_cache(maxsize=4096)
def _short_tag(cut: str) -> tuple[bool, str, str]:
    """(closes, lower-case name or "", attributes) of a tag without its marks."""
    t = _TAG.match(cut)
    return (bool(t.group(1)), t.group(2).lower(), t.group(3)) if t else (False, "", "")


def _tag(cut: str) -> tuple[bool, str, str]:
    """As ``_short_tag``, of a tag that is not kept."""
    return (False, "a", cut[1:]) if cut[:2] == "a " else _short_tag.__wrapped__(cut)


@lru_cache(maxsize=4096)
def _not_shown(attributes: str) -> bool:
    return _NOT_SHOWN.search(attributes) is not None


@dataclass(slots=True)
class Block:
    """Inline content between block boundaries."""

    tag: str
    parent: int
    pieces: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    said: list[str] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)
    words: int = 0
    link_words: int = 0
    list_kind: str = ""
    row: int = -1

    @property
    def text(self) -> str:
        return " ".join(self.said)

    @property
    def heading(self) -> bool:
        return self.tag in _HEADINGS

    @property
    def cell(self) -> bool:
        return self.tag in _CELLS

    @property
    def all_links(self) -> bool:
        return self.words > 0 and self.link_words >= 0.6 * self.words


@dataclass
class Layout:
    blocks: list[Block]
    plain: bool
    title: str
    pieces: int


def blocks_of(page: str) -> Layout:
    """The visible blocks of a page, in order, with the numbers of their pieces.

    Pieces are numbered from 0 over the non-blank cuts of the whole page, hidden ones included.
    """
    #: Of each open element the name (with ! if it is not shown), its number, whether it hides and whether it links.
    stack: list[tuple[str, int, bool, bool]] = [("body", 0, False, False)]
    containers, blocks, title = 1, [], ""
    hidden = links = piece = rows = 0
    block: Block | None = None
    plain = True

    def pop_to(depth: int) -> None:
        nonlocal hidden, links
        while len(stack) > depth:
            _, _, hides, link = stack.pop()
            hidden -= hides
            links -= link

    for cut, _, text in tags_of(page):
        closes, name, attributes = _short_tag(cut) if len(cut) < 22 else _tag(cut)
        if name:
            plain = False
            if name not in _INLINE:
                block = None
            if closes:
                # The body has number 0, so it is never closed.
                if stack[-1][0] == name and stack[-1][1]:
                    _, _, hides, link = stack.pop()
                    hidden -= hides
                    links -= link
                elif depth := next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0].rstrip("!") == name), 0):
                    pop_to(depth)
            elif name != "br":
                if name in _IMPLIED:
                    ends, scopes = _IMPLIED[name]
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in scopes:
                            break
                        if stack[i][0] in ends:
                            pop_to(i)
                elif name in _ENDS_P and stack[-1][0] != "body":
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            pop_to(i)
                            break
                        if stack[i][0] not in _INLINE:
                            break
                if name not in _VOID and not attributes.endswith("/"):
                    rows += name == "tr"
                    link = name == "a"
                    if link and links:
                        pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0].rstrip("!") == "a"))
                    hides = name in _HIDDEN
                    if attributes and not hides and not link and _not_shown(attributes):
                        name, hides = name + "!", True
                    containers += 1
                    stack.append((name, containers, hides, link))
                    hidden += hides
                    links += link
        if not text or not plain and text.isspace():
            continue
        for k, line in enumerate(_BREAK.split(text) if "\n" in text or "\r" in text else (text,)):
            if k and plain:
                block = None
            shown = line.strip()
            if not shown:
                continue
            piece += 1
            if hidden:
                if stack[-1][0] == "title":
                    title += shown
                continue
            if block is None:
                own = len(stack) - 1 if stack[-1][0] not in _INLINE else next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), 0)
                tag = stack[own][0]
                parent = stack[max(0, own - 1) if tag in _IN_CONTAINER else own][1]
                kind = next((x[0] for x in reversed(stack) if x[0] in ("ul", "ol")), "") if tag == "li" else ""
                block = Block(tag, parent, list_kind=kind, row=rows if tag in ("td", "th") else -1)
                blocks.append(block)
            block.pieces.append(piece - 1)
            said = shown.split()
            n = len(said) if shown[0] not in _MARKS else len(_WORD.findall(shown))
            if "&" in shown:
                shown = html.unescape(shown)
                said = shown.split()
            block.texts.append(shown)
            block.said += said
            block.linked.append(links > 0)
            block.words += n
            if links:
                block.link_words += n
    return Layout(blocks, plain, title, piece)


def render(blocks: list[Block]) -> str:
    """Text of blocks: headings and paragraphs apart, list items marked and numbered, table cells aligned."""
    out: list[str] = []
    i, number = 0, 0
    while i < len(blocks):
        b = blocks[i]
        if b.row >= 0:
            rows: dict[int, list[str]] = {}
            while i < len(blocks) and blocks[i].row >= 0:
                rows.setdefault(blocks[i].row, []).append(blocks[i].text)
                i += 1
            widths = [max(len(r[c]) for r in rows.values() if c < len(r)) for c in range(max(map(len, rows.values())))]
            out += ["", *("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=False)).rstrip() for r in rows.values())]
            number = 0
            continue
        if b.tag == "li":
            number += 1
            first = i == 0 or blocks[i - 1].tag != "li"
            out += [""] * first + [(f"{number}. " if b.list_kind == "ol" else "* ") + b.text]
        else:
            number = 0
            out += ["", b.text]
        i += 1
    return "\n".join(out).strip()
