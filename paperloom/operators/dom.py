"""A small HTML tree on the standard parser, with the selectors that documentation pages need."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = set("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {  # an opening tag ends these where they are open
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"},
}
_BLOCKS = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "p": {"td", "th", "li", "div", "table"}}


class Node:
    """An element, or a text where tag is empty."""

    __slots__ = ("tag", "attrs", "children", "text", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent:
            self.parent.children.remove(self)
            self.parent = None

    def replace(self, other: Node) -> None:
        siblings = self.parent.children
        other.parent = self.parent
        siblings[siblings.index(self)] = other
        self.parent = None

    def walk(self) -> Iterator[Node]:
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            stack.extend(reversed(x.children))

    def content(self) -> str:
        return self.text if not self.tag else "".join(x.text for x in self.walk() if not x.tag)

    def select(self, selectors: str) -> list[Node]:
        """Elements that fit any of the comma-separated selectors, in document order."""
        ways = [_compile(x) for x in selectors.split(",")]
        return [x for x in self.walk() if x.tag and any(_fits(x, w) for w in ways)]


_STEP = re.compile(r"([a-z0-9*]+)?((?:[.#][\w-]+|\[[^\]]+\])*)", re.I)
_TEST = re.compile(r"([.#])([\w-]+)|\[([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?\]")
_compiled: dict[str, list] = {}


def _compile(selector: str) -> list:
    selector = selector.strip()
    if selector not in _compiled:
        steps = []
        for part in selector.replace(">", " > ").split():
            if part == ">":
                steps.append(">")
                continue
            tag, rest = _STEP.fullmatch(part).groups()
            steps.append(((tag or "*").lower(), _TEST.findall(rest)))
        _compiled[selector] = steps
    return _compiled[selector]


def _is(x: Node, step: tuple) -> bool:
    tag, tests = step
    if tag not in ("*", x.tag):
        return False
    for kind, name, attr, value in tests:
        if kind == "." and name not in x.attrs.get("class", "").split() or kind == "#" and x.attrs.get("id") != name:
            return False
        if attr and (attr not in x.attrs or value and x.attrs[attr] != value):
            return False
    return True


def _fits(x: Node, steps: list) -> bool:
    if not _is(x, steps[-1]):
        return False
    rest, at = steps[:-1], x.parent
    while rest:
        if rest[-1] == ">":
            rest = rest[:-1]
            if at is None or not _is(at, rest[-1]):
                return False
            rest, at = rest[:-1], at.parent
            continue
        while at is not None and not (at.tag and _is(at, rest[-1])):
            at = at.parent
        if at is None:
            return False
        rest, at = rest[:-1], at.parent
    return True


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def _close(self, tags: set[str], scopes: set[str]) -> None:
        x = self.at
        while x is not None and x is not self.root and x.tag not in scopes:
            if x.tag in tags:
                self.at = x.parent
            x = x.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            self.root.attrs.update({k: v or "" for k, v in attrs})
            return
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _SCOPES.get(tag, set()))
        if tag in _BLOCKS:
            self._close({"p"}, _SCOPES["p"])
        x = self.at.add(Node(tag, {k: v or "" for k, v in attrs}))
        if tag not in VOID:
            self.at = x

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.add(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        x = self.at
        while x is not None and x is not self.root:
            if x.tag == tag:
                self.at = x.parent
                return
            x = x.parent

    def handle_data(self, data: str) -> None:
        self.at.add(Node("", text=data))


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root
