"""HTML to leaf blocks: the text between block boundaries, with the tags above it.  No DOM library is needed."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())  # text up to their end tag, no markup
FOREIGN = frozenset("svg math".split())  # empty where the tag closes itself
UNSEEN = frozenset("template svg canvas audio video select datalist".split())  # elements whose text is no page text
P_CLOSERS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_NAME_AT = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
_TAG_END = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+>")
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-label)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # the distinct tags above, the innermost last
    names: frozenset[str]  # words of the class, id and role attributes above
    link_chars: int
    parent: int = 0  # number of the innermost block element
    is_hidden: bool = False


@dataclass(slots=True)
class _Open:
    """An open element and what its ancestors and it add up to: each block shares them, none copies its path."""

    tag: str
    parent: _Open | None
    number: int
    depth: int
    path: tuple[str, ...]  # distinct tags above and here
    names: frozenset[str]
    hidden: bool
    linked: bool
    block: _Open | None  # the innermost open element that is no inline one
    same: _Open | None  # the next open element of this tag further up


def _attributes(source: str) -> tuple[tuple[str, ...], bool]:
    names, hidden = [], False
    for m in _ATTR.finditer(source):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif key in ("class", "id", "role"):
            names += _NAME.findall(value)
    return tuple(names), hidden


def _tokens(source: str):
    """(text, "") and (attributes, tag) pairs in page order; tag has a slash in front where it closes.

    Every character is looked at a bounded number of times: a tag that never ends, or an open quote, is found
    once and taken as text from then on.
    """
    at, size, text_from = 0, len(source), 0
    last_comment_end, last_tag_end = source.rfind("-->"), source.rfind(">")
    raw_gone: set[str] = set()
    while (at := source.find("<", at)) >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4) + 3 if last_comment_end >= at + 4 else size
            if at > text_from:
                yield source[text_from:at], ""
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at) + 1 if last_tag_end > at else size
            if at > text_from:
                yield source[text_from:at], ""
        else:
            m = _NAME_AT.match(source, at + 1)
            if m is None or last_tag_end < at:
                at += 1
                continue
            body = _TAG_END.match(source, m.end())
            # a quote that never closes: the tag ends at the next angle bracket all the same
            end = body.end() if body else source.find(">", m.end()) + 1
            if at > text_from:
                yield source[text_from:at], ""
            tag = m[0].lower()
            yield source[m.end() : end - 1], tag
            if tag in RAW and tag not in raw_gone:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I).search(source, end)
                if close is None:
                    raw_gone.add(tag)  # the rest of the page, for scripts and styles only
                if close or tag in ("script", "style"):
                    end = close.end() if close else size
        at = text_from = end
    if text_from < size:
        yield source[text_from:], ""


def parse(source: str | None) -> list[Block]:
    """The non-empty blocks in page order.  White space inside a block is one space; references are decoded.

    Work grows in proportion to the page, however deep or broken its markup.  Scripts, styles, templates and
    drawings have no text; the text of math, noscript and object elements stays.
    """
    out: list[Block] = []
    top = _Open("", None, 0, 0, (), frozenset(), False, False, None, None)
    newest: dict[str, _Open] = {}  # the innermost open element of each tag
    text: list[str] = []
    linked, numbers, unseen = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            above = top.block.number if top.block else 0
            out.append(Block(joined, top.path, top.names, min(linked, len(joined)), above, top.hidden))
        text.clear()
        linked = 0

    def close(to: _Open) -> None:
        """Close down to ``to``, it included."""
        nonlocal top, unseen
        while True:
            gone, top = top, top.parent
            unseen -= gone.tag in UNSEEN
            if gone.same is None:
                del newest[gone.tag]
            else:
                newest[gone.tag] = gone.same
            if gone is to:
                return

    for piece, tag in _tokens(source or ""):
        if not tag:
            if not unseen:
                text.append(piece)
                if top.linked:
                    linked += len(piece.strip())
            continue
        if tag[0] == "/":  # an end tag closes down to its start tag, where there is one
            tag = tag[1:]
            if tag not in INLINE:
                flush()
            own = newest.get(tag)
            if own is not None and not (tag in INLINE and top.block is not None and top.block.depth > own.depth):
                close(own)
            continue
        if tag in RAW:
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID or piece.endswith("/") and (tag in FOREIGN or tag not in INLINE):
            continue
        if tag in P_CLOSERS or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("p",) if tag in P_CLOSERS else {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            if top.block is not None and top.block.tag in same:
                close(top.block)
        names, hidden = _attributes(piece) if piece else ((), False)
        numbers += 1
        own = _Open(
            tag, top, numbers, top.depth + 1, top.path if tag == (top.path[-1] if top.path else "") else (*(t for t in top.path if t != tag), tag),
            top.names.union(names) if names else top.names, top.hidden or hidden, top.linked or tag == "a", top.block, newest.get(tag),
        )
        if tag not in INLINE:
            own.block = own
        newest[tag] = top = own
        unseen += tag in UNSEEN
    flush()
    return out
