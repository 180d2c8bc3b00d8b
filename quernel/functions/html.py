"""HTML pages as small trees, and selectors over them. Used inside Arrow-batched functions; nothing here knows Spark."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end an open paragraph when they start.
_BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Element]:
        """This element's descendants in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            yield e
            todo += [c for c in reversed(e.children) if isinstance(c, Element)]

    def own_texts(self) -> list[str]:
        return [c for c in self.children if isinstance(c, str)]

    def all_texts(self) -> list[str]:
        out: list[str] = []
        todo: list = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo += reversed(c.children)
        return out


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.top = Element("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self.end_open("p", "button")
        if tag == "li":
            self.end_open("li", "ul")
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.top)
        self.top.children.append(e)
        if tag not in _VOID:
            self.top = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.top = self.top.parent

    def end_open(self, tag: str, fence: str = "") -> None:
        e = self.top
        while e is not self.root and e.tag != fence:
            if e.tag == tag:
                self.top = e.parent
                return
            e = e.parent

    def handle_endtag(self, tag: str) -> None:
        self.end_open(tag)

    def handle_data(self, data: str) -> None:
        if self.top.children and isinstance(self.top.children[-1], str):
            self.top.children[-1] += data
        else:
            self.top.children.append(data)


def parse(html: str | None) -> Element:
    """The tree of a page; whatever is malformed is closed where a browser would close it."""
    builder = _Builder()
    builder.feed(html or "")
    HTMLParser.close(builder)
    return builder.root


_STEP = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w:-]+)(?:=["']?(?P<val>[^"'\]]*)["']?)?\]|:contains\(["'](?P<has>[^"']*)["']\)""")
_END = re.compile(r"\s*::(text|attr\(([\w:-]+)\))\s*$")


@lru_cache(512)
def _compile(selector: str) -> tuple:
    """((steps, what), ...): steps of (relation, tests); what is `text`, `all` (text of descendants) or an attribute."""
    groups = []
    for part in selector.split(","):
        end = _END.search(part)
        what = "" if not end else "text" if end[1] == "text" else "@" + end[2]
        if what == "text" and end and part[end.start()] == " ":
            what = "all"
        bare = part[: end.start()] if end else part
        steps, relation = [], " "
        for piece in bare.replace(">", " > ").split():
            if piece == ">":
                relation = ">"
                continue
            tests = [m.groupdict() for m in _STEP.finditer(piece)]
            steps.append((relation, tests))
            relation = " "
        groups.append((steps, what))
    return tuple(groups)


def _fits(e: Element, tests: list[dict]) -> bool:
    for t in tests:
        if t["tag"] and t["tag"] != "*" and e.tag != t["tag"].lower():
            return False
        if t["id"] and e.attrs.get("id") != t["id"]:
            return False
        if t["cls"] and t["cls"] not in e.attrs.get("class", "").split():
            return False
        if t["attr"] and (t["attr"] not in e.attrs or t["val"] is not None and e.attrs[t["attr"]] != t["val"]):
            return False
        if t["has"] is not None and t["has"] not in "".join(e.all_texts()):
            return False
    return True


def _matches(e: Element, steps: list) -> bool:
    relation, tests = steps[-1]
    if not _fits(e, tests):
        return False
    if len(steps) == 1:
        return True
    up = e.parent
    while up is not None:
        if _matches(up, steps[:-1]):
            return True
        if relation == ">":
            return False
        up = up.parent
    return False


def select(root: Element, selector: str) -> list[str]:
    """Texts or attributes of the elements that any part of the selector matches, in document order, each element once per kind."""
    groups = _compile(selector)
    out: list[str] = []
    for e in root.walk():
        done = set()
        for steps, what in groups:
            if what in done or not _matches(e, steps):
                continue
            done.add(what)
            if what == "text":
                out += e.own_texts()
            elif what == "all":
                out += e.all_texts()
            elif what and what[1:] in e.attrs:
                out.append(e.attrs[what[1:]])
    return out


def first(root: Element, chain: list[str]) -> str | None:
    """The first non-empty value that the first fruitful selector of a chain finds."""
    for selector in chain:
        got = select(root, selector)
        if got and got[0]:
            return got[0]
    return None
