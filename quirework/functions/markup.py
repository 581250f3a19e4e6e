"""Web and book markup to markdown, with the standard library's HTML parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements by their part in the page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "head", "title"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "figure", "figcaption", "address", "form", "fieldset", "dl", "dt", "dd", "body", "html", "center", "details", "summary"}
PICTURES = {"img", "svg", "image"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """A forgiving tree: stray end tags are ignored, open ones closed with their parent; p, li, td, tr and option end at the next one."""

    # What an opening tag ends.
    ENDS = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # the open elements, from the root on; nodes don't know their parents, so a page's tree is free as soon as it is written
        self.open = [Node("", {})]

    def handle_starttag(self, tag, attrs):
        ends = self.ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS or re.fullmatch("h[1-6]|ul|ol|table|pre|blockquote|hr", tag) else set())
        if self.open[-1].tag in ends:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at:
            del self.open[at:]

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    tree.close()
    return tree.open[0]


def text_of(node) -> str:
    return node if isinstance(node, str) else "".join(map(text_of, node.children))


def ruby(node: Node) -> str:
    """{base|reading} for each reading, {base} text before it; what follows the last reading stays as it is."""
    out, base = [], []
    for child in node.children:
        if isinstance(child, Node) and child.tag == "rp":
            continue
        if isinstance(child, Node) and child.tag == "rt":
            reading, under = text_of(child).strip(), "".join(base).strip()
            out.append(f"{{{under}|{reading}}}" if under and reading else under)
            base = []
        elif isinstance(child, Node) and child.tag == "rtc":
            continue
        else:
            base.append(text_of(child))
    return "".join(out) + "".join(base).strip()


def holds_picture(node) -> bool:
    return isinstance(node, Node) and (node.tag in PICTURES or any(map(holds_picture, node.children)))


def empty(node) -> bool:
    return isinstance(node, Node) and node.tag in ("div", "span") and not text_of(node).strip() and not holds_picture(node)


class Writer:
    """Markdown of a tree, block by block."""

    def __init__(self):
        self.blocks: list[str] = []
        self.line: list[str] = []

    def end(self) -> None:
        text = re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[ \t]+", " ", "".join(self.line))).replace("\u0000", "  \n").strip()
        if text:
            self.blocks.append(text)
        self.line = []

    def put(self, node, pre: bool = False) -> None:
        if isinstance(node, str):
            self.line.append(node if pre else re.sub(r"\s+", " ", node))
            return
        tag = node.tag
        if tag in DROPPED or empty(node):
            return
        if tag == "ruby":
            self.line.append(ruby(node))
        elif tag == "br":
            self.line.append("\u0000")
        elif tag == "hr":
            self.end()
            self.blocks.append("* * *")
        elif tag in ("img", "image"):
            self.line.append(f"![{node.attrs.get('alt', '')}]({node.attrs.get('src') or node.attrs.get('href') or node.attrs.get('xlink:href', '')})")
        elif re.fullmatch("h[1-6]", tag):
            self.end()
            inner = self.inner(node)
            if inner:
                self.blocks.append("#" * int(tag[1]) + " " + " ".join(inner.split()))
        elif tag in ("strong", "b", "em", "i"):
            inner, mark = self.inner(node), "**" if tag in ("strong", "b") else "*"
            self.line.append(f"{mark}{inner}{mark}" if inner else "")
        elif tag == "code":
            self.line.append(f"`{text_of(node)}`")
        elif tag == "a":
            inner, href = self.inner(node), node.attrs.get("href")
            self.line.append(f"[{inner}]({href})" if inner and href else inner)
        elif tag == "pre":
            self.end()
            self.blocks.append("```\n" + text_of(node).strip("\n") + "\n```")
        elif tag == "blockquote":
            self.end()
            self.blocks.append("\n".join("> " + x for x in self.whole(node).split("\n")))
        elif tag in ("ul", "ol"):
            self.end()
            items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
            rows = [(f"{k + 1}. " if tag == "ol" else "* ") + self.whole(c).replace("\n", "\n    ") for k, c in enumerate(items)]
            if rows:
                self.blocks.append("\n".join(rows))
        elif tag == "table":
            self.end()
            rows = [[" ".join(self.whole(c).split()) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")] for r in rows_of(node)]
            rows = [r for r in rows if r]
            if rows:
                self.blocks.append("\n".join(["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0]), *("| " + " | ".join(r) + " |" for r in rows[1:])]))
        elif tag in BLOCKS or tag == "":
            self.end()
            for child in node.children:
                self.put(child)
            self.end()
        else:
            for child in node.children:
                self.put(child, pre)

    def inner(self, node: Node) -> str:
        sub = Writer()
        for child in node.children:
            sub.put(child)
        sub.end()
        return "\n".join(sub.blocks)

    def whole(self, node: Node) -> str:
        sub = Writer()
        for child in node.children:
            sub.put(child)
        sub.end()
        return "\n\n".join(sub.blocks)


def rows_of(node: Node) -> list[Node]:
    return [r for c in node.children if isinstance(c, Node) for r in ([c] if c.tag == "tr" else rows_of(c) if c.tag in ("thead", "tbody", "tfoot") else [])]


def body_of(root: Node) -> Node:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "body":
            return node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return root


def normal(text: str) -> str:
    lines = [x.rstrip() for x in re.sub(r"\n{3,}", "\n\n", text).split("\n")]
    return "\n".join(lines).strip() + "\n"


def html_markdown(html: str | None) -> str | None:
    """Clean markdown of a page: markup of presentation goes, ruby, headings, rules, lists, tables and images stay.

    Null stays null; a page without text gives one newline.
    """
    if html is None:
        return None
    writer = Writer()
    writer.put(body_of(parse(html)))
    writer.end()
    # two spaces before a newline are a line break: they end a line only inside a block
    return normal("\n\n".join(writer.blocks))


#: Pages that become Python strings at a time.
PAGES = 32


@F.arrow_udf(StringType())
def to_markdown(html: pa.Array) -> pa.Array:
    return markdown_of(html)


def markdown_of(html: pa.Array) -> pa.Array:
    """A batch of pages, a few at a time: beside the batch and its result only those are held."""
    parts = (pa.array([html_markdown(x.as_py()) for x in html.slice(at, PAGES)], pa.string()) for at in range(0, len(html), PAGES))
    return pa.concat_arrays([pa.array([], pa.string()), *parts])
