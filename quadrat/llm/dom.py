"""A forgiving reader of HTML: text blocks with the labelled path of elements that hold them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import xxhash

_OPEN = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_words = str.split

VOID = frozenset(_words("area base br col embed hr img input link meta param source track wbr"))
#: Elements whose content is no markup, and those whose text is never shown.
RAW = frozenset(_words("script style textarea title iframe noembed noframes xmp"))
INLINE = frozenset(_words(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr"
))
#: Elements that are never part of the main text.
NEVER = frozenset(_words(
    "aside audio canvas dialog footer head iframe input map menu nav noembed noframes object option script select style svg "
    "template textarea title video xmp"
))
#: Words in class, id or role that name what is not main text.
HINTS = frozenset(_words(
    "ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright dialog discussion disqus footer form gdpr login masthead menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "recommendations recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar topbar widget"
))
#: Not part of the main text unless inside an article.
CONTROLS = frozenset(_words("button noscript"))
#: Hold controls, but on some sites the whole page.
FORMS = frozenset(_words("form fieldset"))
#: Inside an article a name is a verdict only if it is made of hints and of these words, and not of the ambiguous ones alone.
STRUCTURE = frozenset(_words(
    "area bar block box button buttons container content desktop form icon icons inner item items left link links list mobile outer "
    "panel right section slot title top bottom unit wrap wrapper"
))
AMBIGUOUS = frozenset(_words("discussion respond search"))
HEADINGS = frozenset(_words("h1 h2 h3 h4 h5 h6"))
#: Elements deeper than this are not opened; their text belongs to the element at that depth.
DEPTH = 256
#: The next word of a class is no hint after one of these.
_DENIED = frozenset(_words("no non not without has with"))
#: Plain text elements; without class or id they belong to the text that holds them.
PLAIN = frozenset(_words(
    "blockquote caption dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul"
))
_HOLDERS = frozenset(_words("article aside blockquote body details div fieldset footer form header html li main nav section table td th"))
_CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
_RESTARTS = {
    "li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]),
    "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"]),
}


@dataclass
class Element:
    """An open element; ``label`` is its tag with class and id words, digits left out.

    ``chain`` holds the nodes from the root to this element, a node being a hash of the node above and the label.
    """

    tag: str
    label: str
    dropped: bool
    region: int
    plain: bool
    chain: tuple[int, ...] = ()
    children: list[str] = field(default_factory=list)
    forms: tuple[int, ...] = ()


@dataclass
class Block:
    text: str
    chain: tuple[int, ...]
    region: int  # number of the article or main element that holds it, 0 for none
    plain: bool  # nothing but plain text elements since the region began
    forms: tuple[int, ...] = ()


@dataclass
class Page:
    blocks: list[Block]
    styles: dict[tuple[int, ...], set[tuple[str, ...]]]
    mains: set[int]
    hinted: set[int] = field(default_factory=set)  # nodes inside an article whose names hold a hint
    doubtful: set[int] = field(default_factory=set)  # articles inside something that a hint names
    holding: set[int] = field(default_factory=set)  # forms with an article or main element
    inner: set[int] = field(default_factory=set)  # forms inside an article


def next_tag(source: str, at: int, dead: set[int]) -> tuple[int, int, str, str, str] | None:
    """Begin and end of the next markup, and its slash, name and attributes (empty for comments and the like).

    Every character is looked at a bounded number of times: ``dead`` remembers the quotes from which no end of a tag was
    found, and without any ``>`` ahead only comments are looked for.
    """
    while (i := source.find("<", at)) >= 0:
        m = _OPEN.match(source, i)
        if not m:
            at = i + 1
        elif m[1] or m[2] or m[3]:
            mark = "-->" if m[1] else "]]>" if m[2] else ">"
            j = source.find(mark, m.end())
            return i, j + len(mark) if j >= 0 else len(source), "", "", ""
        else:
            end = _tag_end(source, m.end(), dead)
            if end:
                return i, end, m[4], m[5], source[m.end() : end - 1]
            j = source.find("<!--", i)
            if j < 0:
                return None
            at = j
    return None


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Behind the ``>`` that ends a tag, not counting those in quotes if quotes are closed; 0 if there is none."""
    opened, pos = [], at
    while m := _STOP.search(source, pos):
        if m[0] == ">":
            return m.end()
        if m.start() in dead:
            break
        opened.append(m.start())
        j = source.find(m[0], m.end())
        if j < 0:
            break
        pos = j + 1
    dead.update(opened)
    return source.find(">", at) + 1


def _below(chain: tuple[int, ...], label: str) -> tuple[int, ...]:
    return (*chain, xxhash.xxh3_64_intdigest(f"{chain[-1] if chain else 0}/{label}") - (1 << 63))


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _named(attributes: dict[str, str]) -> list[list[str]]:
    """Words of each class, id and role, in order."""
    names = " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split()
    return [[w.lower() for w in _PART.findall(n)] for n in names]


def _hinted(names: list[list[str]], skip: frozenset[str] = frozenset()) -> bool:
    return any(
        w in HINTS and w not in skip and not (k and words[k - 1] in _DENIED) for words in names for k, w in enumerate(words)
    )


def _verdict(names: list[list[str]]) -> bool:
    """Whether a name inside an article says what it is: hints and words of structure only."""
    for words in names:
        hints = [w for k, w in enumerate(words) if w in HINTS and not (k and words[k - 1] in _DENIED)]
        if hints and all(w in HINTS or w in STRUCTURE for w in words) and not all(w in AMBIGUOUS for w in hints):
            return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    style = attributes.get("style", "").replace(" ", "").lower()
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style


def read(source: str) -> Page:
    """Blocks of text outside dropped elements, and the child sequences (styles) of every element path.

    Markup need not be well-formed: paragraphs, items and cells close each other, an end tag closes what is
    open inside its element, one without a start is ignored.
    """
    stack: list[Element] = [Element("", "", False, 0, False)]
    page = Page([], {}, set())
    parts: list[str] = []
    regions = forms = 0
    dead: set[int] = set()
    unopened: Counter = Counter()

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text and not stack[-1].dropped:
                top = next(e for e in reversed(stack) if e.tag not in INLINE)
                page.blocks.append(Block(text, top.chain, top.region, top.plain, top.forms))

    def close(k: int) -> None:
        """Close all elements from position ``k`` of the stack."""
        if any(e.tag not in INLINE for e in stack[k:]):
            flush()
        for e in reversed(stack[k:]):
            if e.tag not in INLINE and not e.dropped:
                page.styles.setdefault(e.chain, set()).add(tuple(e.children))
        del stack[k:]

    def text(piece: str) -> None:
        if piece and not stack[-1].dropped:
            parts.append(html.unescape(piece))

    at = 0
    while found := next_tag(source, at, dead):
        start, end, slash, tag, rest = found
        text(source[at:start])
        at = end
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if unopened[tag]:
                unopened[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            flush()
            _close_implied(stack, tag, close)
        if tag in VOID:
            continue
        top = stack[-1]
        attributes = _attributes(rest) if rest else {}
        names = _named(attributes) if rest else []
        inside = top.region > 0
        hard = tag in NEVER or _hidden(attributes) or (tag in CONTROLS and not inside)
        named = False
        if tag == "article":
            hard = hard or any(w in ("comment", "comments", "reply", "replies") for n in names for w in n)
        elif tag not in ("html", "body", "main") and tag not in HEADINGS | FORMS:
            if inside:
                named = _verdict(names)
            else:
                named = tag == "header" or _hinted(names) or any("header" in n for n in names)
        elif tag in HEADINGS and not inside:
            named = _hinted(names)
        dropped = top.dropped or hard or named
        main = tag == "main" or ["main"] in names and attributes.get("role", "").lower() == "main"
        # an article stands even inside something that a mere name has dropped
        lost = dropped and not hard and tag == "article" and not any(e.tag in NEVER for e in stack[1:] if e.dropped)
        begins = (not dropped or lost) and (tag == "article" or main) and not (inside and top.region not in page.mains)
        if begins:
            regions += 1
            if main and tag != "article":
                page.mains.add(regions)
            if lost:
                page.doubtful.add(regions)
                dropped = False
            page.holding.update(top.forms)
        raw = tag in RAW and not rest.endswith("/")
        if len(stack) > DEPTH and not (dropped and not top.dropped) and not raw and not begins:
            unopened[tag] += 1
            continue
        label = tag + "".join(sorted({f".{w}" for n in names for w in n}))
        plain = not begins and tag in PLAIN and not names and (inside and (top.plain or top.tag in ("article", "main") or top.tag in INLINE))
        e = Element(tag, label, dropped, regions if begins else top.region, plain, forms=top.forms)
        if tag in FORMS and not dropped:
            forms += 1
            e.forms = (*top.forms, forms)
            if inside and top.region not in page.mains:
                page.inner.add(forms)
        if tag in INLINE:
            e.chain, e.plain, e.children = top.chain, top.plain, top.children
        else:
            e.chain = _below(top.chain, label) if len(top.chain) < DEPTH else top.chain
            if not top.children or top.children[-1] != label:
                top.children.append(label)
            if begins:
                e.plain = True
            elif inside and tag not in HEADINGS and _hinted(names):
                page.hinted.add(e.chain[-1])
        stack.append(e)
        if raw:
            close_ = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|\\Z)", re.I).search(source, at)
            at = close_.start() if close_ else len(source)
    text(source[at:])
    close(1)
    flush()
    return page


def _close_implied(stack: list[Element], tag: str, close) -> None:
    """A block closes an open paragraph; items, cells and terms close their like."""
    # only inline elements can be open above a paragraph
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == "p":
            close(k)
            break
        if stack[k].tag in _HOLDERS or stack[k].tag not in INLINE:
            break
    closes = _CLOSES.get(tag)
    if closes:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in closes:
                close(k)
                break
            if stack[k].tag in _RESTARTS[tag] or stack[k].tag in ("div", "section", "article", "body"):
                break


def main_blocks(page: Page) -> list[Block]:
    """The blocks of all articles, else of the main elements, else all; without forms.

    A form that holds an article, or outside of articles at least half of the text that is left, is a container like
    others. Articles inside something that a name has dropped count only where there is nothing else.
    """
    total = sum(len(b.text) for b in page.blocks)
    sizes: Counter = Counter()
    for b in page.blocks:
        for f in b.forms:
            sizes[f] += len(b.text)
    real = {f for f, n in sizes.items() if f not in page.holding and (f in page.inner or 2 * n < total)}
    blocks = [b for b in page.blocks if not real.intersection(b.forms)]
    articles = [b for b in blocks if b.region and b.region not in page.mains]
    sure = [b for b in articles if b.region not in page.doubtful]
    mains = [b for b in blocks if b.region in page.mains]
    return sure or mains or articles or blocks
