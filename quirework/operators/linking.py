"""Linking mentions to entities: an ordered fold per book, and its set-based parts."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import truncated_words
from .resolve import STYLES, SUMMARY, similarity_of, summary_fold  # noqa: F401

SIMILAR = 0.95
ENTITY_SCHEMA = "book_id string, entity_id string, category string, name string, summary string, n_mentions int, sources array<string>, translations array<string>, aliases array<string>, nicknames array<string>, speech_style string, notes string, hints array<string>, first_seen string, last_seen string"
#: Rows of a slice that become Python objects at a time.
ROWS = 1000
LINK_SCHEMA = "book_id string, ord int, entity_id string, how string"


def exact_links(mentions: DataFrame) -> DataFrame:
    """(book_id, source, first_ord, n): the mentions that the first rule, equal source, brings together."""
    return mentions.groupBy("book_id", "source").agg(F.min("ord").alias("first_ord"), F.count("*").alias("n"))


def next_ids(existing: DataFrame, new: DataFrame, category: str, id_: str, order: str) -> DataFrame:
    """``new`` with entity ids that go on from the highest number of the category's existing ones."""
    top = existing.groupBy(category).agg(F.max(F.regexp_extract(id_, r"_(\d+)$", 1).try_cast("int")).alias("_top"))
    number = F.coalesce("_top", F.lit(0)) + F.row_number().over(Window.partitionBy(category).orderBy(order))
    return new.join(top, category, "left").withColumn(id_, F.concat(F.col(category), F.format_string("_%06d", number))).drop("_top")


def merged_summary(old: str, new: str, limit: int = SUMMARY) -> str:
    """Skip what is in the old one; else append, and cut long ones at a space with three dots."""
    if not new or new in old:
        return old
    both = f"{old} {new}".strip()
    return both if len(both) <= limit else both[:limit].rsplit(" ", 1)[0] + "..."


def joined_notes(old: str, new: str) -> str:
    """Notes one after another, those left out that are in it already."""
    return old if not new or new in old else f"{old} {new}".strip()


def text_of(m, name: str) -> str:
    value = getattr(m, name, None)
    return value if isinstance(value, str) else ""


def list_of(m, name: str) -> list:
    value = getattr(m, name, None)
    return [] if value is None or isinstance(value, float) else list(value)


class Book:
    """The entities of one book while its mentions are folded in.

    Entities are known by equal sources, by reading and translation, and, for similar sources, by
    the characters of their category's sources: only those that share enough of them are compared.
    """

    def __init__(self, similar: float = SIMILAR):
        self.similar = similar
        self.entities: list[dict] = []
        self.by_source: dict[str, dict] = {}
        self.by_reading: dict[tuple[str, str], dict] = {}
        self.last_number: dict[str, int] = {}
        self.spelled: dict[tuple[str, str], list[tuple[int, str]]] = {}

    def known(self, e: dict) -> dict:
        """Take an entity in, as the newest."""
        e["place"] = len(self.entities)
        self.entities.append(e)
        number = re.search(r"_(\d+)$", e["entity_id"])
        if number:
            self.last_number[e["category"]] = max(self.last_number.get(e["category"], 0), int(number[1]))
        for source, form in e["forms"].items():
            self.index(e, source, form)
        return e

    def index(self, e: dict, source: str, form: dict) -> None:
        if source not in self.by_source:
            self.by_source[source] = e
        if form["reading"]:
            self.by_reading.setdefault((form["reading"], form["translation"]), e)
        for c in set(source.lower()):
            self.spelled.setdefault((e["category"], c), []).append((e["place"], source))

    def alike(self, category: str, source: str) -> list[dict]:
        """Entities of the category with a similar source, two at most: more than one is as good as none."""
        shared = Counter(x for c in set(source.lower()) for x in set(self.spelled.get((category, c), ())))
        n, found = len(source.strip()), {}
        for (place, other), k in shared.items():
            longer, m = max(n, len(other.strip())), len(other.strip())
            # k kinds of common characters and the lengths bound the similarity: matches are at most the shorter length
            top = (1 + min(n, m) / max(longer, 1) + 1) / 3
            if place not in found and top + 0.4 * (1 - top) >= self.similar and similarity_of(other, source) >= self.similar:
                found[place] = self.entities[place]
                if len(found) > 1:
                    break
        return list(found.values())

    def find(self, m) -> tuple[dict | None, str]:
        """The first rule that hits: equal source; equal reading and translation; the only one of the category with a similar source."""
        if (e := self.by_source.get(m.source)) is not None:
            return e, "source"
        if text_of(m, "reading") and (e := self.by_reading.get((m.reading, m.translation))) is not None:
            return e, "reading"
        found = self.alike(m.category, m.source)
        return (found[0], "similar") if len(found) == 1 else (None, "new")

    def add(self, m) -> tuple[dict, str]:
        e, how = self.find(m)
        if e is None:
            number = self.last_number.get(m.category, 0) + 1
            e = self.known({"entity_id": f"{m.category}_{number:06d}", "category": m.category, "name": m.translation, "summary": "", "notes": "", "speech_style": "", "n_mentions": 0, "forms": {}, "aliases": [], "nicknames": {}, "first_seen": m.chunk_id, "last_seen": m.chunk_id, "fixed": False})
        elif e["fixed"]:
            return e, how
        e["n_mentions"] += 1
        form = e["forms"].get(m.source)
        told, reading, hint, notes = text_of(m, "translation"), text_of(m, "reading"), text_of(m, "context_hint"), text_of(m, "notes")
        if form is None:
            form = e["forms"][m.source] = {"translation": told, "reading": reading, "variants": [], "hints": [], "notes": "", "count": 0, "first_seen": m.chunk_id}
            self.index(e, m.source, form)
        elif told != form["translation"] and told not in form["variants"]:
            form["variants"].append(told)
        if reading and not form["reading"]:
            form["reading"] = reading
            self.by_reading.setdefault((reading, form["translation"]), e)
        form["count"] += 1
        if hint and hint not in form["hints"]:
            form["hints"].append(hint)
        form["notes"] = joined_notes(form["notes"], notes)
        e["summary"] = merged_summary(e["summary"], text_of(m, "summary"))
        e["notes"] = joined_notes(e["notes"], notes)
        e["aliases"] += [x for x in dict.fromkeys(list_of(m, "aliases")) if x not in e["aliases"]]
        for x in list_of(m, "nicknames"):
            e["nicknames"].setdefault(x["speaker"], x["nick"])
        style = text_of(m, "speech_style")
        if style and style not in e["speech_style"].split(STYLES):
            e["speech_style"] = f"{e['speech_style']}{STYLES}{style}" if e["speech_style"] else style
        e["last_seen"] = m.chunk_id
        return e, how


def taken_in(book: Book, k: SimpleNamespace) -> None:
    """An entity that the book begins with."""
    forms = {x["source"]: {"translation": x["translation"] or "", "reading": x["reading"] or "", "variants": [], "hints": [], "notes": "", "count": 0, "first_seen": ""} for x in list_of(k, "forms")}
    book.known({"entity_id": k.entity_id, "category": k.category, "name": k.name, "summary": text_of(k, "summary"), "notes": text_of(k, "notes"), "speech_style": text_of(k, "speech_style"), "n_mentions": 0, "forms": forms, "aliases": list_of(k, "aliases"), "nicknames": {}, "first_seen": "", "last_seen": "", "fixed": k.origin == "user"})


def folded(batches: Iterator[pa.RecordBatch], similar: float, each: bool) -> Iterator[tuple]:
    """Books one after another, of each first the entities known, then the mentions in order: with ``each`` (book_id, ord, entity_id, how) of each mention, else (book_id, Book) at a book's end.

    Rows are read a slice at a time, so that a book's entities are all that is held of it.
    """
    book, at = None, None
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            for row in batch.slice(start, ROWS).to_pylist():
                if book is None or row["book_id"] != at:
                    if book is not None and not each:
                        yield at, book
                    book, at = Book(similar), row["book_id"]
                if row["known"] is not None:
                    taken_in(book, SimpleNamespace(**row["known"]))
                    continue
                e, how = book.add(SimpleNamespace(**row["mention"]))
                if each:
                    yield at, row["ord"], e["entity_id"], how
    if book is not None and not each:
        yield at, book


def in_order(mentions: DataFrame, known: DataFrame | None) -> DataFrame:
    """(book_id, ord, known, mention): a book's rows in one partition, the entities known before the mentions, those in their order."""
    told = mentions.select("book_id", "ord", F.lit("").alias("_id"), F.struct(*[c for c in mentions.columns if c != "book_id"]).alias("mention"))
    if known is None:
        rows = told.withColumn("known", F.lit(None).cast("struct<entity_id:string>"))
    else:
        first = known.select("book_id", F.lit(None).cast(mentions.schema["ord"].dataType).alias("ord"), F.col("entity_id").alias("_id"), F.struct(*[c for c in known.columns if c != "book_id"]).alias("known"))
        rows = first.unionByName(told, allowMissingColumns=True)
    order = ("book_id", F.col("known").isNull(), "_id", F.col("ord").asc_nulls_last())
    return rows.repartition("book_id").sortWithinPartitions(*order).select("book_id", "ord", "known", "mention")


def record_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in iter(lambda: list(islice(rows, ROWS)), []):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def fold_mentions(mentions: DataFrame, similar: float = SIMILAR, known: DataFrame | None = None) -> DataFrame:
    """(book_id, ord, entity_id, how): each mention's entity, seeing the entities of earlier ones; one task a book.

    mentions: book_id, ord, source, category, translation, chunk_id and, where there are such,
    reading, summary, notes, context_hint, speech_style, aliases array<string>, nicknames
    array<struct<speaker, nick>>.  known: entities that a book begins with (book_id, entity_id,
    category, name, origin, forms array<struct<source, translation, reading>> and others); those of
    origin ``user`` take mentions but never change.
    """

    linking = [c for c in ("book_id", "ord", "source", "category", "translation", "reading", "chunk_id") if c in mentions.columns]
    schema = to_arrow_schema(StructType.fromDDL(LINK_SCHEMA))
    return in_order(mentions.select(*linking), known).mapInArrow(lambda batches: record_batches(folded(batches, similar, True), schema), LINK_SCHEMA)


def fold_entities(mentions: DataFrame, similar: float = SIMILAR, known: DataFrame | None = None) -> DataFrame:
    """The entities that the fold leaves, in the order of their creation."""
    schema = to_arrow_schema(StructType.fromDDL(ENTITY_SCHEMA))

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for book_id, book in folded(batches, similar, False):
            for e in book.entities:
                told = dict.fromkeys(t for f in e["forms"].values() for t in [f["translation"], *f["variants"]] if t)
                row = e | {"book_id": book_id, "sources": list(e["forms"]), "translations": list(told), "hints": list(dict.fromkeys(h for f in e["forms"].values() for h in f["hints"])), "nicknames": [f"{s}: {n}" for s, n in e["nicknames"].items()]}
                yield tuple(row[c] for c in schema.names)

    return in_order(mentions, known).mapInArrow(lambda batches: record_batches(entities(batches), schema), ENTITY_SCHEMA)


def corrected(corrections: DataFrame, entities: DataFrame, forms: DataFrame, links: DataFrame) -> DataFrame:
    """Corrections as conflicts: ``links`` (as ``conflicts`` takes them) with a row for each correction, after the book's own.

    corrections: ord, existing_translation, source_term, corrected_translation.  A correction isn't
    applied by itself: it stands as another translation of its target for the decisions to come.
    """
    aimed = correction_targets(corrections, entities, forms)
    known = entities.select("entity_id", F.col("category").alias("_category"))
    told = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("existing_translation").alias("t")), F.struct(F.lit(1).alias("k"), F.col("corrected_translation").alias("t")))).alias("_t")
    rows = aimed.join(known, "entity_id", "left").select("entity_id", "ord", F.col("source_term").alias("source"), F.coalesce("_category", F.lit("")).alias("category"), told)
    top = links.agg(F.max("ord").alias("_top"))  # one row
    late = rows.crossJoin(F.broadcast(top)).select("entity_id", (F.coalesce("_top", F.lit(0)) + 2 * F.col("ord") + F.col("_t.k") + 1).alias("ord"), "source", F.col("_t.t").alias("translation"), "category")
    return links.select("entity_id", F.col("ord").cast("long").alias("ord"), "source", "translation", "category").unionByName(late.withColumn("ord", F.col("ord").cast("long")))


def require_categories(entities: DataFrame, allowed: list[str]) -> DataFrame:
    """``entities``, or an error that names the categories which aren't allowed and up to ten entities of each."""
    wrong = entities.where(~F.coalesce(F.col("category").isin(*allowed), F.lit(False))).groupBy("category").agg(F.min("name").alias("first"), F.count("*").alias("n")).orderBy("category").limit(10).collect()
    if wrong:
        raise ValueError("categories that are not allowed: " + "; ".join(f"{r['category']} ({r['n']} entities, the first {r['first']})" for r in wrong))
    return entities


def surface_forms(links: DataFrame) -> DataFrame:
    """A row an (entity, source): count, first translation, its variants in order, first reading, first chunk.

    links: entity_id, ord, source, reading, translation, chunk_id.
    """
    # combined by translation first, so that a row holds distinct translations and never all links
    row = F.struct("ord", "translation", "reading", "chunk_id")
    one = links.groupBy("entity_id", "source", "translation").agg(F.count("*").alias("n"), F.min("ord").alias("o"), F.min(row).alias("first"), F.min(F.when(F.length("reading") > 0, row)).alias("read"))
    told = F.array_sort(F.collect_list(F.when(F.length("translation") > 0, F.struct("o", "translation"))))
    by = one.groupBy("entity_id", "source").agg(F.sum("n").alias("occurrence_count"), F.transform(told, lambda x: x["translation"]).alias("told"), F.min("first").alias("first"), F.min("read").alias("read"))
    return by.select("entity_id", "source", "occurrence_count", F.get("told", F.lit(0)).alias("translation"), F.slice("told", 2, 1_000_000).alias("translation_variants"), F.col("read.reading").alias("reading"), F.col("first.chunk_id").alias("first_seen_chunk"))


def conflicts(links: DataFrame) -> DataFrame:
    """A row an entity with differing translations or categories: the current one and the others in order."""
    # combined by value first, so that a row holds distinct values and never all links
    values = F.array(F.struct(F.lit("t").alias("k"), F.col("translation").alias("v")), F.struct(F.lit("c").alias("k"), F.col("category").alias("v")))
    one = links.select("entity_id", F.struct("ord", "source", "translation", "category").alias("row"), F.explode(values).alias("x")).groupBy("entity_id", "x").agg(F.min("row").alias("first"))
    kept = lambda which: F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("first", "x.v")))), lambda y: y["v"])
    by = one.groupBy("entity_id").agg(F.min("first").alias("first"), kept((F.col("x.k") == "t") & (F.length("x.v") > 0)).alias("told"), kept(F.col("x.k") == "c").alias("kinds"))
    rows = by.select("entity_id", F.col("first.source").alias("source_form"), F.get("told", F.lit(0)).alias("current_translation"), F.slice("told", 2, 1_000_000).alias("alternatives"), F.slice("kinds", 2, 1_000_000).alias("category_variants"))
    return rows.where((F.size("alternatives") > 0) | (F.size("category_variants") > 0))


def correction_targets(corrections: DataFrame, entities: DataFrame, forms: DataFrame) -> DataFrame:
    """Each correction's entity: the only one of that name, else the only one with that surface form, else unknown:<term>."""
    name = entities.groupBy(F.col("name").alias("_n")).agg(F.min("entity_id").alias("_by_name"), F.count("*").alias("_c")).where("_c = 1").drop("_c")
    form = forms.groupBy(F.col("source").alias("_s")).agg(F.min("entity_id").alias("_by_form"), F.countDistinct("entity_id").alias("_d")).where("_d = 1").drop("_d")
    both = corrections.join(name, corrections["existing_translation"] == F.col("_n"), "left").join(form, corrections["source_term"] == F.col("_s"), "left")
    return both.withColumn("entity_id", F.coalesce("_by_name", "_by_form", F.concat(F.lit("unknown:"), F.col("source_term")))).drop("_n", "_s", "_by_name", "_by_form")


def compressed(observations: DataFrame, provider: Callable[[DataFrame], DataFrame], limit: int = SUMMARY, again: bool = False) -> DataFrame:
    """(entity_id, summary) from observations (entity_id, origin, summary, chunk_id, text).

    One observation is the summary; of several, in the order of chunks, one call makes it
    (``provider`` maps (entity_id, text) to (entity_id, answer)), and an empty or missing answer
    leaves them joined.  Entities of origin ``user`` and, unless ``again``, those that have a summary
    are left out.  Summaries are cut at a word to ``limit`` characters.
    """
    todo = observations.where((F.col("origin") != "user") & (F.lit(again) | F.col("summary").isNull() | (F.length("summary") == 0)) & (F.length("text") > 0))
    by = todo.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))).alias("l")).select("entity_id", F.size("l").alias("n"), F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("text"))
    told = provider(by.where("n > 1").select("entity_id", "text")).select("entity_id", F.trim("answer").alias("answer"))
    whole = by.join(told, "entity_id", "left").select("entity_id", F.when(F.length("answer") > 0, F.col("answer")).otherwise(F.col("text")).alias("summary"))
    return whole.withColumn("summary", truncated_words(F.col("summary"), limit))


def compression_work(entities: DataFrame) -> DataFrame:
    """What each entity's summary needs: nothing, its only observation, or one call.  entities: source, summary, observations array<string>."""
    n = F.size("observations")
    what = F.when((F.col("source") == "user") | (n <= 0), "none").when(n == 1, "direct").otherwise("call")
    return entities.withColumn("work", what).withColumn("direct", F.when(n == 1, F.get("observations", F.lit(0))))


def reconcile_work(forms: DataFrame, found: DataFrame, styles: DataFrame) -> DataFrame:
    """The three work sets: forms with variants, conflicts (category-only ones need no call), speech styles of several lines."""
    a = forms.where(F.size("translation_variants") > 0).select(F.lit("variants").alias("work"), "entity_id", F.col("source").alias("item"), F.lit(True).alias("needs_call"))
    b = found.select(F.lit("conflict"), "entity_id", F.col("source_form"), F.size("alternatives") > 0)
    c = styles.where(F.col("speech_style").contains("\n")).select(F.lit("speech"), "entity_id", F.lit(None).cast("string"), F.lit(True))
    return a.union(b).union(c)


def reconciled(forms: DataFrame, entities: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forms, entities and a report after decisions (work, entity_id, item, value).

    ``variants``: the form takes the value as its translation and keeps no variants; ``conflict``: the
    entity takes it as its name; ``speech``: as its way of speaking.  Of several decisions on one
    thing the smallest value counts; empty values decide nothing.  forms: entity_id, source,
    translation, translation_variants; entities: entity_id, name, speech_style.
    """
    given = decisions.where(F.length(F.trim("value")) > 0).groupBy("work", "entity_id", "item").agg(F.min("value").alias("value"))
    of = lambda work, *keys: given.where(F.col("work") == work).select(*keys, F.col("value").alias(f"_{work}"))
    a = forms.join(of("variants", "entity_id", F.col("item").alias("source")), ["entity_id", "source"], "left")
    none = F.array().cast(forms.schema["translation_variants"].dataType)
    new_forms = a.withColumns({"translation": F.coalesce("_variants", "translation"), "translation_variants": F.when(F.col("_variants").isNotNull(), none).otherwise(F.col("translation_variants"))}).select(*forms.columns)
    one = lambda work: given.where(F.col("work") == work).groupBy("entity_id").agg(F.min("value").alias(f"_{work}"))
    b = entities.join(one("conflict"), "entity_id", "left").join(one("speech"), "entity_id", "left")
    new_entities = b.withColumns({"name": F.coalesce("_conflict", "name"), "speech_style": F.coalesce("_speech", "speech_style")}).select(*entities.columns)
    report = given.groupBy("work").agg(F.count("*").alias("n_decisions"))
    return new_forms, new_entities, report
