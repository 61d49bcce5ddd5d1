"""A page as a tree of elements, by the standard library's parser, and the few searches that readers need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template", "noscript"}
#: An opening tag ends an open element of these kinds, up to the nearest of the second ones.
_ENDS = {"p": ({"p"}, {"div", "section", "article", "body", "td", "li"}), "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Element | str] = []

    def walk(self) -> Iterator[Element]:
        """All elements below, in document order."""
        for child in self.children:
            if isinstance(child, Element):
                yield child
                yield from child.walk()

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def find_all(self, *tags: str, **patterns: str) -> Iterator[Element]:
        """Elements of one of the tags (any if none) whose attributes match the patterns; ``cls`` stands for class."""
        for e in self.walk():
            if (not tags or e.tag in tags) and all(re.search(p, e.attrs.get("class" if k == "cls" else k) or "", re.I) for k, p in patterns.items()):
                yield e

    def find(self, *tags: str, **patterns: str) -> Element | None:
        return next(self.find_all(*tags, **patterns), None)

    def above(self, *tags: str) -> Element | None:
        e = self.parent
        while e is not None and e.tag not in tags:
            e = e.parent
        return e

    def text(self, between: str = "") -> str:
        """The stripped texts below, joined."""
        parts: list[str] = []
        todo: list[Element | str] = [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts += [x.strip()] if x.strip() else []
            elif x.tag not in _HIDDEN:
                todo += reversed(x.children)
        return between.join(parts)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            ends, bounds = _ENDS[tag]
            e, last = self.at, None
            while e.parent is not None and e.tag not in bounds:
                if e.tag in ends:
                    last = e
                e = e.parent
            if last is not None:
                self.at = last.parent
        child = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(child)
        if tag not in _VOID:
            self.at = child

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        e = self.at
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Element:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root
