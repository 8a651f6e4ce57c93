"""Leaf blocks of HTML pages: stretches of text that no block element interrupts, with their ancestors.

Mark-up is read from left to right by the HTML standard's states of tags and attributes, each character
once, so a page of any form takes time in proportion to its length. Two departures keep text that
browsers would lose: a quotation mark that is never closed ends with its tag, and an element that hides
its content hides nothing if it is never closed, scripts and styles apart. A tag that never ends is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_PLAIN = re.compile(r"[^\s>]*")
_PART = re.compile(r"[a-z]+")
#: Elements whose content isn't text of the page; those of RAW hold no mark-up. Fixed values.
RAW = frozenset(("script", "style", "textarea", "iframe"))
HIDDEN = RAW | frozenset(("noscript", "template", "svg"))
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in HIDDEN}
#: Elements that don't end a block. Fixed values of the HTML standard's phrasing content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph, list item, cell or option of the same kind.
_CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


@dataclass(eq=False)
class Node:
    """An element: its parent, tag, and what it adds to its ancestors' tags and to the parts of their class, id and role."""

    parent: Node | None
    tag: str
    fresh: tuple[str, ...]


@dataclass
class Block:
    """text with single spaces, the element it is in, characters in links."""

    text: str
    node: Node | None
    linked: int


class Reader:
    """Reads a page's tags; each method moves on by what it has read."""

    def __init__(self, page: str):
        self.page = page
        end = page.rfind(">")
        # A quotation mark that closes only after the last tag's end closes nothing.
        self.last = {">": end, **{c: page.rfind(c, 0, max(0, end)) for c in "\"'"}}
        self.open_ended: set[str] = set()  # hidden elements whose end doesn't come any more

    def tag(self, at: int) -> tuple[int, str, bool, bool, list[str]] | None:
        """(end, name, is an end tag, closes itself, values of class, id and role) of the tag at '<'; None: it is text, as is a tag that never ends."""
        page = self.page
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if not name:
            return None
        i, values, slash = name.end(), [], False
        while True:
            gap = _GAP.match(page, i)
            i, slash = gap.end(), gap[0].endswith("/")
            if i > self.last[">"]:  # the page ends within the tag
                return None
            if page[i] == ">":
                return i + 1, name[0].lower(), closing, slash, values
            attribute = _ATTRIBUTE.match(page, i)
            i = attribute.end()
            equals = _EQUALS.match(page, i)
            if not equals:
                continue
            i = equals.end()
            quote = page[i : i + 1]
            if quote and quote in "\"'" and i < self.last[quote]:
                end = page.find(quote, i + 1)
                value, i = page[i + 1 : end], end + 1
            else:
                value = _PLAIN.match(page, i)[0]
                i += len(value)
            if attribute[0].lower() in ("class", "id", "role"):
                values.append(value)

    def skip(self, at: int) -> int | None:
        """The end of a comment or declaration at '<'; None: it is none."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) if at + 4 <= self.last[">"] else -1
            return end + 3 if end >= 0 else len(page)
        if page.startswith(("<!", "<?", "</"), at):
            return page.find(">", at) + 1 if at < self.last[">"] else None
        return None

    def hidden_end(self, name: str, at: int) -> int:
        """Where the content of a hidden element ends that begins at a place."""
        if name not in self.open_ended:
            end = _END[name].search(self.page, at)
            if end:
                return end.start()
            self.open_ended.add(name)
        return len(self.page) if name in RAW else at


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order. Null and empty pages have none; broken mark-up is read as far as it goes."""
    if not page:
        return []
    reader, out, parts = Reader(page), [], []
    stack: list[tuple[Node, list[str]]] = []
    open_tags, features = Counter(), Counter()
    links, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block(text, stack[-1][0] if stack else None, linked))
        parts.clear()
        linked = 0

    def push(tag: str, values: list[str]) -> None:
        own = [f"in={tag}", *(f"name={x}" for x in _PART.findall(" ".join(values).lower()))]
        fresh = tuple(dict.fromkeys(x for x in own if not features[x]))
        features.update(own)
        open_tags[tag] += 1
        stack.append((Node(stack[-1][0] if stack else None, tag, fresh), own))

    def pop() -> None:
        node, own = stack.pop()
        features.subtract(own)
        open_tags[node.tag] -= 1

    at = 0
    while at < len(page):
        lt = page.find("<", at)
        end = len(page) if lt < 0 else lt
        if end > at:
            parts.append(html.unescape(page[at:end]))  # a reference doesn't reach over a tag
            linked += (end - at) * (links > 0)
        if lt < 0:
            break
        found = reader.tag(lt)
        if not found:
            at = reader.skip(lt)
            if at is None:
                parts.append("<")
                at = lt + 1
            continue
        at, tag, closing, closed, values = found
        if tag in HIDDEN and not closing:
            if not closed:
                at = reader.hidden_end(tag, at)
            continue
        if tag in HIDDEN:
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if closing:
            if open_tags[tag]:
                while stack[-1][0].tag != tag:
                    pop()
                pop()
        elif tag not in VOID and not closed:
            links = 0
            top = stack[-1][0].tag if stack else ""
            if top and (top in _CLOSES.get(tag, ()) or tag not in _CLOSES and top == "p"):
                pop()
            push(tag, values)
    flush()
    return out
