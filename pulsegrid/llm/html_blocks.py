"""HTML pages as sequences of text blocks.

A block is the text between two block-level boundaries; inline tags do not
divide it. Each block carries its tag path with the class, id and role words of
every ancestor. Scripts, styles, comments, titles, templates and a page's head
have no text; formulas are text of their line.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_MARKUP = re.compile(
    r"<!--(?:(?!-->).)*(?:-->|$)|<![^>]*>|<\?[^>]*>"
    r"|<(script|style|title|template|textarea|noscript|svg|iframe)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:/>|>.*?(?:</\1\s*>|$))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Fixed: HTML's inline, void and self-closing vocabularies.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr "
    "math annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle "
    "msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
#: Elements of a page's head; any other one ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "p": {"p"},
}
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
_HOLDS = frozenset("ul ol dl table tbody thead tfoot select body article section div main aside nav header footer form blockquote".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # per ancestor that is no bare inline tag: tag and its attribute words, blank-separated
    linked: int  # code points inside links
    inline: int  # inline elements opened inside


def _step(tag: str, attrs: str) -> str:
    if not attrs or "=" not in attrs:
        return tag
    words = [w.lower() for m in _NAMED.finditer(attrs) for w in _NAME_WORD.findall(m[1] or m[2] or m[3] or "")]
    return " ".join([tag, *dict.fromkeys(words)])


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a whole page in page order; character references
    are decoded and white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    linked = inline = links = 0
    in_head = False
    path: tuple[str, ...] | None = None

    def flush() -> None:
        nonlocal held, linked, inline, path
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append(Block(text, path or (), linked, inline))
        held, linked, inline, path = [], 0, 0, None

    def text(piece: str) -> None:
        nonlocal linked, path
        if piece and not in_head:
            if path is None and not piece.isspace():
                path = tuple(s for t, s in stack if t not in INLINE or t == "a" or " " in s)
            held.append(piece)
            if links:
                linked += len(piece)

    def close_to(k: int) -> None:
        nonlocal links
        links -= sum(t == "a" for t, _ in stack[k:])
        del stack[k:]

    at = 0
    for m in _MARKUP.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            if m[1]:
                flush() if m[1].lower() != "svg" else None
            continue
        tag = m[3].lower()
        if tag == "head":
            in_head = not m[2] and all(t != "body" for t, _ in stack)
            continue
        if not m[2] and tag not in _IN_HEAD:
            in_head = False
        if m[2]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # a stray inline end tag
            continue
        if tag not in INLINE:
            flush()
            shut = _CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        close_to(k)
                        break
                    if stack[k][0] in _HOLDS:
                        break
        else:
            inline += 1
        if tag not in VOID:  # a slash closes nothing in HTML
            stack.append((tag, _step(tag, m[4])))
            links += tag == "a"
    text(page[at:])
    flush()
    return out
