"""A small document tree over the standard HTML parser, with the selectors that card and detail layouts need.

Supported: tag, .class, #id, [attr], [attr='x'], [attr*='x'], descendants, and lists separated by commas.  Malformed markup never raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
HIDDEN = {"script", "style", "template", "noscript"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def walk(self) -> Iterator[Node]:
        """Descendants in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def strings(self) -> Iterator[str]:
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                yield x
            elif x.tag not in HIDDEN:
                todo += reversed(x.children)

    def text(self) -> str:
        """Text with white space collapsed, one blank between pieces."""
        return " ".join(" ".join(self.strings()).split())

    def select(self, selector: str) -> list[Node]:
        groups = _parsed(selector)
        return [n for n in self.walk() if any(_fits(n, steps) for steps in groups)]

    def first(self, selectors: list[str] | tuple[str, ...]) -> Node | None:
        """The first hit of the first selector that has one."""
        for s in selectors:
            groups = _parsed(s)
            for n in self.walk():
                if any(_fits(n, steps) for steps in groups):
                    return n
        return None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag == "li" and self.at.tag == "li":
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_PART = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:(\*?=)'([^']*)')?\]|([a-z][\w]*)")


@cache
def _parsed(selector: str) -> list[list[list[tuple]]]:
    """Groups of steps of conditions."""
    out = []
    for group in selector.split(","):
        steps = []
        for step in re.findall(r"(?:[^\s\[]|\[[^\]]*\])+", group.strip()):
            conditions = []
            for mark, name, attr, op, value, tag in _PART.findall(step):
                conditions.append(("class", name) if mark == "." else ("is", "id", name) if mark == "#" else ("tag", tag) if tag else ("has", attr) if not op else ("is" if op == "=" else "in", attr, value))
            steps.append(conditions)
        out.append(steps)
    return out


def _meets(node: Node, conditions: list[tuple]) -> bool:
    for c in conditions:
        if c[0] == "tag" and node.tag != c[1] or c[0] == "class" and c[1] not in node.get("class").split() or c[0] == "has" and c[1] not in node.attrs:
            return False
        if c[0] == "is" and node.attrs.get(c[1]) != c[2] or c[0] == "in" and c[2] not in node.get(c[1]):
            return False
    return True


def _fits(node: Node, steps: list[list[tuple]]) -> bool:
    if not _meets(node, steps[-1]):
        return False
    above, k = node.parent, len(steps) - 2
    while k >= 0 and above is not None:
        if _meets(above, steps[k]):
            k -= 1
        above = above.parent
    return k < 0
