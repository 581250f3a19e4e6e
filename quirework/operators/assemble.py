"""Putting chunks together again, and the markup around them."""

from __future__ import annotations

import html as html_module
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the declarations that set text vertically.
VERTICAL = ("writing-mode", "-webkit-writing-mode", "-epub-writing-mode")


def assembled(parts: DataFrame, doc: str, order: str, text: str, expected: DataFrame | None = None, count: str | None = None) -> DataFrame:
    """(doc, text, n_parts, complete): texts in order, parted by blank lines; complete if ``expected`` (doc, count) is met."""
    by = parts.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_p"))
    out = by.select(doc, F.array_join(F.transform("_p", lambda x: F.coalesce(x["t"], F.lit(""))), "\n\n").alias("text"), F.size("_p").alias("n_parts"))
    if expected is None:
        return out.withColumn("complete", F.lit(True))
    both = expected.select(doc, F.col(count).alias("_n")).join(out, doc, "left")
    return both.select(doc, F.when(F.col("n_parts") == F.col("_n"), F.col("text")).alias("text"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"), F.coalesce(F.col("n_parts") == F.col("_n"), F.lit(False)).alias("complete"))


def missing_parts(expected: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(parts.select(*keys).distinct(), keys, "left_anti")


def drifted(assembled_tokens: Column, chunk_tokens: Column, n_chunks: Column) -> Column:
    """Whether the tokens of a whole differ from its chunks' by more than joins explain."""
    return F.abs(assembled_tokens - chunk_tokens) > F.greatest(5 * n_chunks, F.lit(10))


def without_declarations(css: Column, properties: tuple[str, ...] = VERTICAL) -> Column:
    """CSS without the declarations of these properties; one without its closing semicolon stays."""
    names = "|".join(sorted(re.escape(p) for p in properties))
    return F.regexp_replace(css, rf"(?i)[ \t]*(?:{names})\s*:[^;]*;\s*?\n?", "")


def distinct_titles(titles: DataFrame, title: str, order: str) -> DataFrame:
    """(title, ord): each title once, by its first place."""
    return titles.groupBy(title).agg(F.min(order).alias("ord"))


#: Inline markup in the order in which it is taken; code spans are set aside first.
CODE = re.compile(r"(`+)(.+?)\1", re.S)
IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)\s]+)\)")
LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")
STRONG = re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", re.S)
EMPHASIS = re.compile(r"\*(?=\S)(.+?)(?<=\S)\*|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", re.S)
RULE = re.compile(r"^\s*[-*_](?:\s*[-*_]){2,}\s*$")
HEADING = re.compile(r"(#{1,6})\s+(.*?)\s*#*$")
ITEM = re.compile(r"( *)([-+*]|\d{1,9}[.)])\s+(\S.*)$")
FENCE = re.compile(r"(`{3,}|~{3,})\s*([\w+-]*)\s*$")
BAR = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")


def with_ruby(text: str) -> str:
    """{base|reading} as ruby: both sides filled, neither with a brace or a bar of its own."""
    out, at = [], 0
    while (begin := text.find("{", at)) >= 0:
        end = text.find("}", begin)
        if end < 0:
            break
        inner = text[begin + 1 : end]
        if "{" in inner:
            begin += 1 + inner.rfind("{")
            inner = text[begin + 1 : end]
        base, bar, reading = inner.partition("|")
        out.append(text[at:begin])
        out.append(f"<ruby>{base}<rt>{reading}</rt></ruby>" if bar and base and reading and "|" not in reading else text[begin : end + 1])
        at = end + 1
    return "".join(out) + text[at:]


def inline(text: str) -> str:
    held: list[str] = []

    def aside(m: re.Match) -> str:
        held.append(f"<code>{html_module.escape(m[2].strip(), quote=False)}</code>")
        return f"\x00{len(held) - 1}\x00"

    text = html_module.escape(CODE.sub(aside, text), quote=False)
    text = IMAGE.sub(r'<img alt="\1" src="\2"/>', text)
    text = LINK.sub(r'<a href="\2">\1</a>', text)
    text = STRONG.sub(r"<strong>\2</strong>", text)
    text = EMPHASIS.sub(lambda m: f"<em>{m[1] or m[2]}</em>", text)
    text = re.sub(r" {2,}\n", "<br/>\n", with_ruby(text))
    return re.sub("\x00(\\d+)\x00", lambda m: held[int(m[1])], text)


def listed(items: list[tuple[int, bool, str]]) -> str:
    """Items (indent, ordered, text) as lists; deeper items become a list inside the item before them."""
    out, at, base, ordered = [], 0, items[0][0], items[0][1]
    while at < len(items) and (items[at][0] <= base) and items[at][1] == ordered:
        inner, deeper = inline(items[at][2]), []
        at += 1
        while at < len(items) and items[at][0] > base:
            deeper.append(items[at])
            at += 1
        out.append(f"<li>{inner}{chr(10) + listed(deeper) + chr(10) if deeper else ''}</li>")
    tag, joined = ("ol" if ordered else "ul"), "\n".join(out)
    rest = f"\n{listed(items[at:])}" if at < len(items) else ""
    return f"<{tag}>\n{joined}\n</{tag}>{rest}"


def table(lines: list[str]) -> str:
    cells = lambda line: [inline(c.strip()) for c in line.strip().strip("|").split("|")]
    row = lambda line, tag: "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells(line)) + "</tr>"
    body = "\n".join(row(x, "td") for x in lines[2:])
    return f"<table>\n<thead>\n{row(lines[0], 'th')}\n</thead>\n<tbody>\n{body}\n</tbody>\n</table>"


def markdown_html(markdown: str | None) -> str | None:
    """Headings, rules, ordered and nested lists, quotes, tables, fenced code and paragraphs as XHTML; {base|reading} as ruby."""
    if markdown is None:
        return None
    out: list[str] = []
    text: list[str] = []
    lines, at = markdown.split("\n"), 0

    def flush() -> None:
        if text:
            out.append(f"<p>{inline(chr(10).join(text))}</p>")
            text.clear()

    def run(holds) -> list[str]:
        """The lines from here on for which ``holds`` is true."""
        nonlocal at
        begin = at
        while at < len(lines) and holds(lines[at]):
            at += 1
        return lines[begin:at]

    while at < len(lines):
        line = lines[at]
        if m := FENCE.match(line):
            flush()
            at += 1
            body = run(lambda x, mark=m[1]: not x.strip().startswith(mark))
            at += 1
            kind = f' class="language-{m[2]}"' if m[2] else ""
            out.append(f"<pre><code{kind}>{html_module.escape(chr(10).join(body), quote=False)}\n</code></pre>")
        elif not line.strip():
            flush()
            at += 1
        elif m := HEADING.match(line):
            flush()
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            at += 1
        elif RULE.match(line):
            flush()
            out.append("<hr/>")
            at += 1
        elif line.startswith(">"):
            flush()
            inner = "\n".join(x[1:].removeprefix(" ") for x in run(lambda x: x.startswith(">")))
            out.append(f"<blockquote>{markdown_html(inner)}</blockquote>")
        elif not text and ITEM.match(line):
            found = [ITEM.match(x) for x in run(lambda x: ITEM.match(x) and not RULE.match(x))]
            out.append(listed([(len(m[1]), m[2][0].isdigit(), m[3]) for m in found]))
        elif not text and "|" in line and at + 1 < len(lines) and "|" in lines[at + 1] and BAR.match(lines[at + 1]):
            out.append(table(run(lambda x: "|" in x)))
        else:
            text.append(line)
            at += 1
    flush()
    return "\n".join(out)


@F.pandas_udf(StringType())
def to_html(markdown: pd.Series) -> pd.Series:
    return markdown.map(markdown_html)
