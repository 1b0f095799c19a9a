"""Text blocks of an HTML page, with what the markup says about each."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# HTML element names by what they are.
SILENT = frozenset("script style noscript template head title svg canvas iframe object embed video audio map select option button input textarea datalist".split())
FRAME = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
# Words in class, id and role that name the parts around an article.
FRAME_WORDS = frozenset(
    "nav navbar navigation menu sidebar aside footer masthead breadcrumb breadcrumbs ad ads advert adverts advertisement advertising banner sponsor sponsored promo "
    "cookie cookies consent notice alert popup modal newsletter subscribe signup login search share sharing social comment comments reply replies respond disqus "
    "related recommended recommendations pagination pager widget toolbar copyright disclaimer contentinfo complementary header topbar skip tags".split()
)
# Words of compounds that leave a frame word's meaning, as in site-footer and nav-list.
FRAME_PARTS = frozenset(
    "site page main top bottom left right primary secondary global mobile desktop area bar block box container form group inner item items link links list outer "
    "panel posts row section slot thread unit wrap wrapper js".split()
)
# Frame words for parts of a layout, which some pages also put around everything.
LAYOUT_WORDS = frozenset("nav navbar navigation menu sidebar aside footer masthead popup modal login search widget toolbar header topbar skip alert notice".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?][^>]*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
#: Elements that end silently at the start of a block of their own sort.
_SELF_ENDING = {"p": frozenset(("p",)), "li": frozenset(("li",)), "dd": frozenset(("dd", "dt")), "dt": frozenset(("dd", "dt")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "tr": frozenset(("tr", "td", "th"))}


@dataclass(frozen=True)
class Line:
    """A block's text; framed if some element around it is page furniture; main if an article is."""

    text: str
    framed: bool
    main: bool
    linked: bool


#: How an element frames: not at all, as a part of the layout, or whatever it holds.
_OPEN, _LAYOUT, _FIRM = range(3)


def _frames(name: str, attributes: str, inside_main: bool) -> int:
    if name == "form":
        found = _LAYOUT
    elif name in FRAME and not (name == "header" and inside_main):
        return _FIRM
    else:
        found = _OPEN
    if _HIDDEN.search(attributes):
        return _FIRM
    if name in ("body", "html"):
        return found
    for groups in _NAMES.finditer(attributes):
        for whole in (groups[1] or groups[2] or groups[3] or "").lower().split():
            parts = set(_WORD.findall(whole))
            words = parts & FRAME_WORDS
            if not words or parts - FRAME_WORDS - FRAME_PARTS or inside_main and words == {"header"}:
                continue
            if words - LAYOUT_WORDS:
                return _FIRM
            found = _LAYOUT
    return found


@dataclass(frozen=True)
class _Found:
    text: str
    firm: bool
    layout: tuple[int, ...]  # elements around the line that frame it as parts of the layout
    main: bool
    linked: bool
    title: bool


def _settled(found: list[_Found], mains: list[tuple[bool, tuple[int, ...]]]) -> list[Line]:
    """The lines, where an element does not frame that holds most of the text or the page's one article.

    Only parts of the layout are let go; adverts, comments and the like are framed however
    long they are. One article with a title outside that stays is a teaser.
    """
    size: dict[tuple[int, ...], int] = {(): 0}
    for x in found:
        if not x.firm:
            size[x.layout] = size.get(x.layout, 0) + len(x.text)
    most = max(size, key=size.get)
    free = set(most) if size[most] > size[()] else set()
    if len(mains) == 1 and not mains[0][0] and not any(x.title and not (x.firm or x.layout or x.main) for x in found):
        free |= set(mains[0][1])
    return [Line(x.text, x.firm or not free.issuperset(x.layout), x.main, x.linked) for x in found]


def lines_of(page: str) -> list[Line]:
    """Blocks with text, in page order. One pass; unclosed and stray tags are tolerated.

    White space inside a block, line breaks included, becomes one space; character
    references are decoded. Silent elements give nothing.
    """
    found: list[_Found] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, tuple[int, ...], bool]] = []  # name, firm, layout, main
    opened: Counter[str] = Counter()  # names on the stack
    endless: set[str] = set()  # silent elements that no later tag ends
    mains: list[tuple[bool, tuple[int, ...]]] = []
    links = at = length = linked = free = elements = 0

    def end_block() -> None:
        nonlocal length, linked, free
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            pieces.clear()
            if text:
                name, firm, layout, main = stack[-1] if stack else ("", False, (), False)
                # A paragraph with words of its own is no list of links.
                mostly = linked >= length - free if name == "p" else 2 * linked > length
                found.append(_Found(text, firm, layout, main, bool(linked) and mostly, name == "h1"))
        length = linked = free = 0

    def take(piece: str) -> None:
        nonlocal length, linked, free
        if piece:
            pieces.append(piece)
            size = len(piece.strip())
            length += size
            linked += size if links else 0
            free += 0 if links or any(map(str.isalnum, piece)) else size

    while at < len(page):
        tag = _TAG.search(page, at)
        if not tag:
            take(page[at:])
            break
        take(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        closing = tag[1] == "/"
        if name == "br":
            pieces.append(" ")
        elif name in SILENT and name not in VOID:
            if closing or tag[0].endswith("/>"):
                continue
            close = None if name in endless else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                endless.add(name)
                at = len(page) if name in ("script", "style") else at
        elif name == "a":
            links = max(0, links - 1) if closing else links + 1
        elif name in BLOCKS:
            end_block()
            links = 0
            if closing:
                while opened[name]:
                    opened[last := stack.pop()[0]] -= 1
                    if last == name:
                        break
            elif name not in VOID:
                ended = _SELF_ENDING.get(name)
                while ended and stack and stack[-1][0] in ended:
                    opened[stack.pop()[0]] -= 1
                _, firm, layout, main = stack[-1] if stack else ("", False, (), False)
                framing = _frames(name, tag[3], main)
                firm = firm or framing == _FIRM
                if framing == _LAYOUT:
                    elements += 1
                    layout = (*layout, elements)
                if name in MAIN and not main:
                    mains.append((firm, layout))
                stack.append((name, firm, layout, main or name in MAIN))
                opened[name] += 1
    end_block()
    return _settled(found, mains)
