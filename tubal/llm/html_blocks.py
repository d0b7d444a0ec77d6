"""Leaf blocks of an HTML page: runs of text between block-level tags, with where they stand."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache, lru_cache
from html import unescape

#: Elements that start and end blocks; all others are inline.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is no text of the page.
RAW_TAGS = frozenset("script style title noscript template textarea iframe svg".split())
_VOID = frozenset("hr".split())
#: A start tag of the key ends an open element of the values.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_NO_P_INSIDE = BLOCK_TAGS - {"button", "label", "legend", "option", "select", "body", "html", "head"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_LETTERS = "^abcdefghijklmnopqrstuvwxyz$"
#: What these elements are named tells of the page, not of a block in it.
_WHOLE_PAGE = frozenset("html body".split())


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I)


#: Words of classes and ids by what they name. Fixed values.
NAME_GROUPS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc tabs pagination pager".split(),
    "head": "header masthead topbar toolbar logo".split(),
    "foot": "footer bottom copyright legal colophon".split(),
    "side": "sidebar side aside widget widgets rail".split(),
    "advert": "ad ads advert adverts advertisement banner promo promotion sponsor sponsored sponsors".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay paywall disclaimer".split(),
    "comment": "comment comments commentlist reply replies discussion disqus respond reader".split(),
    "share": "share sharing social related recommended recommendation newsletter subscribe subscription tags meta byline".split(),
    "form": "form login signup signin register search contact".split(),
    "content": "content article post entry story main text body".split(),
}
_GROUP_OF = {w: g for g, words in NAME_GROUPS.items() for w in words}


@lru_cache(4096)
def _parts(word: str) -> int:
    """Three letters in a row, with marks at both ends, as bits of one number: ``sidebarleft`` shares some with ``sidebar``."""
    marked, bits = f"^{word}$", 0
    places = [_LETTERS.index(c) for c in marked]
    for a, b, c in zip(places, places[1:], places[2:]):
        bits |= 1 << ((a * 28 + b) * 28 + c)
    return bits


def parts_of(bits: int) -> list[str]:
    """The letters that the bits stand for."""
    out = []
    while bits:
        low = bits & -bits
        k = low.bit_length() - 1
        out.append(_LETTERS[k // 784] + _LETTERS[k // 28 % 28] + _LETTERS[k % 28])
        bits ^= low
    return out


def bits_of(part: str) -> int:
    a, b, c = (_LETTERS.index(x) for x in part)
    return 1 << ((a * 28 + b) * 28 + c)


#: Ancestors that tell what a block is; of others only the innermost counts.
TELLING = frozenset("article main nav aside header footer form section ul ol table blockquote figure select button label fieldset dialog details".split())


@dataclass(frozen=True, slots=True)
class Place:
    """Where a block stands: its element, the telling elements around it, and what the words of the classes, ids and roles of all
    elements around it name, as groups and as parts of words. Both are of bounded size, and elements that add nothing share their parent's."""

    tag: str
    around: frozenset[str]
    groups: frozenset[str]
    parts: int


@dataclass(slots=True)
class Block:
    text: str
    place: Place
    link_chars: int


NOWHERE = Place("", frozenset(), frozenset(), 0)


def _inside(outer: Place, tag: str, attributes: str) -> Place:
    around = outer.around if tag not in TELLING or tag in outer.around else outer.around | {tag}
    groups, parts = outer.groups, outer.parts
    for name in _ATTRIBUTE.findall(attributes) if attributes and tag not in _WHOLE_PAGE else ():
        for word in _WORDS.findall(_CAMEL.sub(" ", "".join(name)).lower()):
            own = _parts(word)
            parts = parts if own & ~parts == 0 else parts | own
            group = _GROUP_OF.get(word)
            groups = groups if group is None or group in groups else groups | {group}
    return Place(tag, around, groups, parts)


def blocks_of(html: str) -> list[Block]:
    """In page order, without empty ones; character references decoded, white space made one space. Time
    and memory are linear in the length of the page, however deep its elements nest."""
    out: list[Block] = []
    stack: list[Place] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    links, in_link, at, n = 0, False, 0, len(html)

    def flush() -> None:
        nonlocal links, text
        joined = " ".join(unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, stack[-1] if stack else NOWHERE, min(links, len(joined))))
        text, links = [], 0

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    while at < n:
        m = _TOKEN.search(html, at)
        end = m.start() if m else n
        if end > at:
            piece = html[at:end]
            text.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW_TAGS:
            if not closing and not attributes.endswith("/"):
                closes = _closing(tag).search(html, at)
                at = closes.end() if closes else n
            text.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            in_link = False
            if closing:
                while opened[tag] and close() != tag:
                    pass
            elif tag not in _VOID:
                ended = _ENDS.get(tag, frozenset()) | ({"p"} if tag in _NO_P_INSIDE else frozenset())
                while stack and stack[-1].tag in ended:
                    close()
                stack.append(_inside(stack[-1] if stack else NOWHERE, tag, attributes))
                opened[tag] += 1
    flush()
    return out
