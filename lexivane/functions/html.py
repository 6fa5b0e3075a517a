"""Article text of web pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexivane.functions.batches import slices, small_batches

_VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
_BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "li"))


class Node:
    """An element: its name, attributes, and children, which are elements or texts."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def below(self) -> Iterator[Node]:
        """All elements inside, in the order of their start tags."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        """All text inside but that of scripts, styles and templates."""
        out, stack = [], [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, str):
                    out.append(c)
                elif c.name not in _SILENT:
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()
        return "".join(out)


class _Builder(HTMLParser):
    """A start tag opens an element until an end tag of its name, or of an element around it; nothing closes by itself."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in reversed(attrs)}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _has_class(name: str) -> Callable[[Node], bool]:
    return lambda n: name in n.attrs.get("class", "").split()


#: Where an article is looked for, in turn; the first that matches at all is used.
SELECTORS: tuple[Callable[[Node], bool], ...] = (
    lambda n: n.name == "article",
    lambda n, c=_has_class("post-content"): n.name == "section" and c(n),
    lambda n, c=_has_class("article-content"): n.name == "div" and c(n),
    lambda n: n.name == "div" and n.attrs.get("itemprop") == "articleBody",
)


def article(html: str) -> str | None:
    """The text of a page's headings, paragraphs and list items within its article, a line each.

    Elements inside others repeat their text. Without an article all paragraphs count; None if there are none either.
    """
    builder = _Builder()
    builder.feed(html)
    builder.close()
    everything = list(builder.root.below())
    for selects in SELECTORS:
        if found := [n for n in everything if selects(n)]:
            return "\n".join(b.text().strip() for n in found for b in n.below() if b.name in _BLOCKS).strip()
    if found := [n for n in everything if n.name == "p"]:
        return "\n".join(n.text().strip() for n in found).strip()
    return None


def extract_articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: Sequence[str] = ()) -> DataFrame:
    """``<id_col>, content, error`` of each page and the columns to ``keep``; ``content`` is null, and ``error`` says so, where no article was found.

    Python holds about a megabyte of pages at a time, or one page.
    """
    carried = [id_col, *keep]
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (s for whole in batches for s in slices(whole)):
            content = [None if h is None else article(h) for h in b.column(len(carried)).to_pylist()]
            errors = ["no article found" if c is None else None for c in content]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], pa.array(content, pa.string()), pa.array(errors, pa.string())], [*carried, "content", "error"])

    slim = pages.select(*carried, pages[html_col].cast("string").alias("_lv_html"))
    schema = T.StructType([*[slim.schema[c] for c in carried], T.StructField("content", T.StringType()), T.StructField("error", T.StringType())])
    return slim.mapInArrow(run, schema)
