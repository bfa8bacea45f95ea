"""Markup to lines in one pass: each line the text of one block, with what its containers tell of it.

The scanner follows the HTML standard where text depends on it: quotes count only as the first character of a value,
element names are whole names, comments and scripts run to their end marks (or to the end of the page). Where a page is
broken it loses markup rather than text: a tag that never closes is text (but for one cut off in a quoted value by the
page's end), a quote without its partner is a character, and ``title``, ``textarea`` and the like without an end tag are ignored. No input takes more than linear time: what was
not found once is not looked for again.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

#: A quote is a quote only behind '='; possessive, so that a failing tag fails in one pass.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?)*+)>")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_COMMENT = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)", re.S)
#: A tag that the page's end cuts off within a quoted value.
_CUT = re.compile(r"<[a-zA-Z][^<>]*=\s*[\"'][^<>]*\Z")
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
#: Elements whose content is no markup; with True the content of one that is never closed ends with the page.
_RAW = {"script": True, "style": True, "title": False, "textarea": False, "iframe": False, "noscript": False, "noembed": False, "noframes": False}
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}

#: Elements that end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A new one of these ends an open one.
_ALIKE = frozenset("p li dt dd tr td th option".split())
#: Text elements: their ids are anchors, not names of page parts.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th span blockquote pre a b i em strong".split())

_NOISE_TAGS = frozenset("nav footer aside form button dialog menu search select option datalist template svg".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id that tell boilerplate.
_NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice pager pagination paywall popup promo promoted recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
#: Words that tell boilerplate, but inside the text's container name parts of the text.
_SOFT_WORDS = frozenset("banner header teaser".split())
#: Words that may stand beside those in one name; any other word ("social-policy", "comment-on-law") tells a topic.
_BESIDE = frozenset(
    "area article bar big block blog body bottom box btn button buttons col column container content count desktop div entry feed first fixed form global group holder icon icons id inner item items large last left li link links list main mini mobile module new outer page panel post primary region right root row secondary section site slot small sticky story the title top ul unit user wide wrap wrapper zone".split()
)
#: Words that tell boilerplate on an article or main element itself.
_COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond teaser related promo sponsored advert ad".split())

CLEAN, SOFT, NOISE = 0, 1, 2


class Line:
    """text; its characters in links; CLEAN, SOFT (boilerplate outside the text's container) or NOISE; element numbers."""

    __slots__ = ("article", "box", "linked", "main", "mark", "text", "weak")

    def __init__(self, text: str, linked: int, mark: int, weak: bool, article: int, main: int, box: int) -> None:
        self.text, self.linked, self.mark, self.weak, self.article, self.main, self.box = text, linked, mark, weak, article, main, box


def _names(value: str, words: frozenset[str]) -> bool:
    """Whether a name of ``value`` consists of one of ``words`` and of such as may stand beside it."""
    for name in value.split():
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if len(p) > 1]
        if any(p in words for p in parts) and all(p in words or p in _BESIDE or p in _NOISE_WORDS or p in _SOFT_WORDS for p in parts):
            return True
    return False


@lru_cache(maxsize=4096)
def _judged(tag: str, raw: str) -> tuple[int, bool, str]:
    """The mark of an element, whether only class words or a form tell it, and its class (or else its id)."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    names = found.get("class", "")
    called = names or "#" * ("id" in found) + found.get("id", "")
    if tag in ("html", "body"):
        return CLEAN, False, called
    if tag == "form":
        return NOISE, True, called
    if tag in _NOISE_TAGS or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in _NOISE_ROLES:
        return NOISE, False, called
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) or found.get("itemtype", "").endswith("/Comment"):
        return NOISE, False, called
    told = names if tag in _TEXTS else f"{names} {found.get('id', '')}"
    if _names(told, _COMMENT_WORDS if tag in ("article", "main") else _NOISE_WORDS):
        return NOISE, True, called
    if tag == "header" or (tag not in ("article", "main") and _names(told, _SOFT_WORDS)):
        return SOFT, False, called
    return CLEAN, False, called


def scan(page: str) -> tuple[list[Line], list[tuple[int, str, str]]]:
    """The lines of a page, and its block elements (element around, tag, class or id) with the page as number 0."""
    lines: list[Line] = []
    boxes = [(0, "", "")]
    #: tag, mark, whether the mark is weak, article, main, element, whether text is left out (boilerplate in a line)
    stack: list[tuple[str, int, bool, int, int, int, bool]] = [("", CLEAN, False, 0, 0, 0, False)]
    opened: Counter[str] = Counter()  # how often an element stands in the stack
    text: list[str] = []
    linked = 0
    in_link = False

    def end_line() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                _, mark, weak, article, main, box, _ = stack[-1]
                lines.append(Line(joined, min(linked, len(joined)), mark, weak, article, main, box))
            text.clear()
        linked = 0

    def put(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1][6]:
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at, tags, absent, size = 0, _TAG, set(), len(page)
    last = page.rfind(">")
    while at < size:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            break
        put(page[at:lt])
        at = lt + 1
        kind = page[at : at + 1]
        named = page[at + 1 : at + 2] if kind == "/" else kind
        if not (named.isascii() and named.isalpha()):
            if kind in ("!", "?", "/"):
                m = _COMMENT.match(page, lt) if page.startswith("<!--", lt) else None
                at = m.end() if m else page.find(">", lt) + 1
            else:
                put("<")
            continue
        m = tags.match(page, lt)
        if m is None:
            # Quotes hide every end of a tag: from here on they are characters.
            tags = _BARE
            m = tags.match(page, lt)
        at = m.end()
        tag, closing, raw = m[2].lower(), bool(m[1]), m[3]
        block = tag in BLOCKS
        if tag == "br":
            put(" ")
        elif tag == "a":
            in_link = not closing
        if block:
            end_line()
            if closing:
                in_link = False
        if closing:
            # Stray end tags are ignored; one of a part of a line does not end blocks.
            while opened[tag] and (block or stack[-1][0] not in BLOCKS):
                found = stack[-1][0] == tag
                pop()
                if found:
                    break
            continue
        if tag in _RAW and tag not in absent:
            end = _ENDS[tag].search(page, at)
            if end:
                close = page.find(">", end.start())
                at = close + 1 if close >= 0 else size
                continue
            absent.add(tag)
            if _RAW[tag]:
                at = size
            continue
        if tag in _VOID or (raw[-1:] == "/" and (len(raw) == 1 or raw[-2] in " \t\r\n\"'")):
            continue
        if stack[-1][0] == tag and tag in _ALIKE or (block and stack[-1][0] == "p"):
            pop()
        _, mark, weak, article, main, box, muted = stack[-1]
        own, own_weak, names = _judged(tag, raw) if raw or tag in _NOISE_TAGS or tag == "header" else (CLEAN, False, "")
        if own > mark or (own == mark == NOISE and weak):
            mark, weak = own, own_weak
        if block:
            boxes.append((box, tag, names))
            box = len(boxes) - 1
            if tag == "article" and not article and mark != NOISE:
                article = box
            elif tag == "main" and not main and mark != NOISE:
                main = box
            stack.append((tag, mark, weak, article, main, box, muted))
            opened[tag] += 1
        elif own == NOISE:
            # Boilerplate inside a line leaves the line whole.
            stack.append((tag, mark, weak, article, main, box, True))
            opened[tag] += 1
    tail = page[at:]
    cut = page.rfind("<")
    if cut >= at and _CUT.match(page, cut):
        tail = page[at:cut]
    put(tail)
    end_line()
    return lines, boxes
