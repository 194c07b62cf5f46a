"""Text of HTML: block elements in order, navigation left out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The elements that make blocks, and those that are dropped with all they hold.
BLOCKS = ("p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "li", "td", "th", "article", "section")
DROPPED = ("script", "style", "nav", "header", "footer")
DROPPED_TYPES = ("toc", "landmarks", "pagebreak")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


class _Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def walk(self) -> Iterator[_Node]:
        for x in self.parts:
            if isinstance(x, _Node):
                yield x
                yield from x.walk()

    def texts(self) -> Iterator[str]:
        for x in self.parts:
            if isinstance(x, _Node):
                yield from x.texts()
            elif x.strip():
                yield x.strip()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].parts.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def parse(html: str | bytes) -> _Node:
    tree = _Tree()
    tree.feed(html.decode("utf-8", errors="replace") if isinstance(html, bytes | bytearray) else html)
    tree.close()
    return tree.root


def _drop(node: _Node) -> None:
    def gone(n: _Node) -> bool:
        return n.tag in DROPPED or n.attrs.get("role") == "navigation" or n.attrs.get("epub:type") in DROPPED_TYPES

    node.parts = [x for x in node.parts if not (isinstance(x, _Node) and gone(x))]
    for x in node.parts:
        if isinstance(x, _Node):
            _drop(x)


def html_text(html: str | bytes | None, leaves_only: bool = False) -> str:
    """Block texts, parted by empty lines.

    A block inside a block is given by both, as in the original order of elements; ``leaves_only`` gives inner blocks once.
    Without blocks the body's lines are taken. Null and broken HTML give what can be read, an empty text at worst.
    """
    if not html:
        return ""
    root = parse(html)
    _drop(root)
    out = []
    for node in root.walk():
        if node.tag in BLOCKS and not (leaves_only and any(n.tag in BLOCKS for n in node.walk())):
            text = re.sub(r"\s+", " ", " ".join(node.texts()))
            if text:
                out.append(text)
    if not out:
        body = next((n for n in root.walk() if n.tag == "body"), None)
        if body is not None:
            out = [line.strip() for t in body.texts() for line in t.split("\n") if line.strip()]
    return "\n\n".join(out)


def is_navigation(name: str, html: str | bytes) -> bool:
    """Whether an item of a book is navigation: by its file's name, or by what it holds."""
    if any(x in name.lower() for x in ("nav", "toc", "contents", "cover", "title", "copyright", "ncx")):
        return True
    root = parse(html)
    first = next((n for n in root.walk() if n.tag == "nav"), None)
    if first is not None:
        inner, whole = "".join(first.texts()), "".join(root.texts())
        if len(whole.replace(inner, "")) < 100:
            return True
    return any(n.attrs.get("epub:type") in ("toc", "landmarks") for n in root.walk())


def html_texts(pages: DataFrame, key: str, html: str = "html", leaves_only: bool = False) -> DataFrame:
    """``key, text`` of each page; a map over Arrow batches."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "text": [html_text(x, leaves_only) for x in pdf["h"]]})

    return pages.select(F.col(key).alias("k"), F.col(html).alias("h")).mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)
