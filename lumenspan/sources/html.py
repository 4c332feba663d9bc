"""Articles from HTML by simple CSS selectors, over a small tree of the standard parser's events."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# What stands for a missing part, and the selectors of a news result page.
MISSING = {"press": "언론사 정보 없음", "date": "날짜 정보 없음", "summary": "요약문 없음"}
NEWS = {
    "title": "span.sds-comps-text-type-headline1",
    "around": "div.sds-comps-vertical-layout",
    "summary": "span.sds-comps-text-type-body1",
    "profile": "div[data-sds-comp=Profile]",
    "press": "span.sds-comps-text-type-body2.sds-comps-text-weight-sm",
    "date": "span.sds-comps-profile-info-subtext span.sds-comps-text",
}


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def below(self) -> Iterator[Node]:
        """Elements inside, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        """All text inside, each part trimmed, without scripts."""
        parts, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                parts.append(c.strip())
            elif c.tag not in ("script", "style"):
                todo += reversed(c.children)
        return "".join(parts)


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:  # an end without a start is ignored
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


STEP = re.compile(r"^([\w-]*)((?:\.[\w-]+)*)(?:\[([\w-]+)=\"?([^\]\"]*)\"?\])?$")


def fits(node: Node, step: str) -> bool:
    """Whether an element is what ``tag.class.class[name=value]`` says."""
    tag, classes, name, value = STEP.match(step).groups()
    return (not tag or node.tag == tag) and set(filter(None, classes.split("."))) <= set(node.attrs.get("class", "").split()) and (name is None or node.attrs.get(name) == value)


def select(root: Node, selector: str) -> list[Node]:
    """Elements that a selector names; blanks stand for "anywhere inside"."""
    *outer, last = selector.split()
    found = []
    for node in root.below():
        if fits(node, last):
            up, steps = node.parent, list(outer)
            while steps and up is not None and up is not root:
                if fits(up, steps[-1]):
                    steps.pop()
                up = up.parent
            if not steps:
                found.append(node)
    return found


#: An ampersand that begins no reference with its semicolon.
OPEN = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")


def tree(html: str | None, closed: bool = False) -> Node:
    """``closed``: only references with their semicolon are resolved; else also those that HTML knows without, such as ``&amp``."""
    parser = Tree()
    parser.feed(OPEN.sub("&amp;", html or "") if closed else html or "")
    parser.close()
    return parser.root


def page_articles(html: str | None, names: dict[str, str], closed: bool = False) -> list[tuple[str, str, str, str]]:
    """(title, press, date, summary) of each title: the summary of the block around it, press and date of the profile with
    the same number."""
    root = tree(html, closed)
    profiles = select(root, names["profile"]) if "profile" in names else []

    def part(inside: Node | None, name: str) -> str:
        hits = select(inside, names[name]) if inside is not None and name in names else []
        return hits[0].text() if hits else MISSING[name]

    out = []
    for k, title in enumerate(select(root, names["title"])):
        around = title.parent
        while around is not None and "around" in names and not fits(around, names["around"]):
            around = around.parent
        profile = profiles[k] if k < len(profiles) else None
        out.append((title.text(), part(profile, "press"), part(profile, "date"), part(around, "summary")))
    return out


def articles(pages: DataFrame, html: str, keys: list[str], names: dict[str, str] | None = None, closed: bool = False) -> DataFrame:
    """keys, k, title, press, date, summary of every page; ``closed`` as in ``tree``."""
    names = names or NEWS

    @F.pandas_udf("array<struct<title:string,press:string,date:string,summary:string>>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("title", "press", "date", "summary"), row)) for row in page_articles(v, names, closed)] for v in values])

    return pages.select(*keys, F.posexplode(run(F.col(html))).alias("k", "a")).select(*keys, "k", "a.title", "a.press", "a.date", "a.summary")


def texts(html: Column, selector: str) -> Column:
    """array<string>: the texts of all elements that a selector names."""

    @F.pandas_udf("array<string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: [n.text() for n in select(tree(v), selector)])

    return run(html)
