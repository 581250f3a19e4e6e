"""Tables of contents: titles out of the books, one call a book, and back again."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.provider import Provider, structured
from ..sources import epub
from .prompts import prompt


def listed(content: bytes) -> list[str]:
    """The titles of an archive entry; none if it is no table of contents or can't be read."""
    try:
        return epub.toc_titles(content.decode("utf-8", "replace"))
    except ElementTree.ParseError:
        return []


def tables_of_contents(entries: DataFrame) -> DataFrame:
    """The entries that may hold a table of contents: an NCX, or markup with a navigation element."""
    text = F.col("content").cast("string")
    return entries.where(F.col("name").endswith(".ncx") | (F.col("name").rlike(r"(?i)\.x?html?$") & text.rlike(r"(?i)<(?:\w+:)?nav\b")))


def titles(entries: DataFrame) -> DataFrame:
    """(path, title, ord): each title of a book's tables of contents once, by its first place; NCX titles come first."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(p, t, (not n.endswith(".ncx")) * 2**40 + o * 2**20 + i) for p, n, o, c in zip(pdf.path, pdf.name, pdf.ord, pdf.content) for i, t in enumerate(listed(bytes(c))) if t]
            yield pd.DataFrame(rows, columns=["path", "title", "ord"])

    found = tables_of_contents(entries).select("path", "name", "ord", "content").mapInPandas(run, "path string, title string, ord long")
    return found.groupBy("path", "title").agg(F.min("ord").alias("ord"))


def glossary(entities: DataFrame, forms: DataFrame, categories: tuple[str, ...] = ()) -> DataFrame:
    """(book_id, glossary): ``source -> translation`` lines of the entities of these categories (of all if none is named), in order.

    entities: book_id, entity_id, category, ord.  forms: book_id, entity_id, source, translation.
    """
    chosen = entities.where(F.col("category").isin(*categories)) if categories else entities
    lines = chosen.select("book_id", "entity_id", "ord").join(forms.where(F.length("translation") > 0), ["book_id", "entity_id"])
    ordered = F.array_sort(F.collect_list(F.struct("ord", "source", "translation")))
    return lines.groupBy("book_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["source"], F.lit(" -> "), x["translation"])), "\n").alias("glossary"))


def translated_titles(found: DataFrame, factory: Callable[[], Provider], source: str, target: str, terms: DataFrame | None = None) -> DataFrame:
    """(path, title, translated) by one call a book with all its titles; an answer of another length is asked for again, then an error.

    terms: path, glossary.
    """
    rows = found.join(terms, "path", "left") if terms is not None else found.withColumn("glossary", F.lit(None).cast("string"))

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord")
        known = pdf.glossary.iloc[0]
        asked = "\n".join(pdf.title) + (f"\n\nTerms:\n{known}" if isinstance(known, str) and known else "")

        def wrong(answer: dict) -> str | None:
            got = answer.get("titles")
            return None if isinstance(got, list) and len(got) == len(pdf) and all(isinstance(t, str) for t in got) else f"{len(pdf)} titles are needed"

        answer = structured(factory(), [{"role": "system", "content": prompt("titles", source=source, target=target)}, {"role": "user", "content": asked}], wrong, shape={"titles": ["string"]})
        return pd.DataFrame({"path": pdf.path, "title": pdf.title, "translated": answer["titles"]})

    return rows.groupBy("path").applyInPandas(book, "path string, title string, translated string")


def rewritten(entries: DataFrame, translated: DataFrame) -> DataFrame:
    """(path, name, content) of the tables of contents with their titles translated; a title without translation stays."""
    maps = translated.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("title", "translated"))).alias("map"))

    def change(content: bytes, by: dict) -> bytes | None:
        old = listed(bytes(content))
        new = [by.get(t) or t for t in old]
        return epub.with_titles(bytes(content).decode("utf-8", "replace"), new).encode() if new != old else None

    out = tables_of_contents(entries).join(maps, "path").select("path", "name", F.udf(change, "binary")("content", "map").alias("content"))
    return out.where(F.col("content").isNotNull())
