"""Substring deduplication: paragraphs by MinHash banding and exact verification, sentences inside them by equality.

A paragraph is a line; its words are lower-cased (A-Z) and parted by white space.  Equal paragraphs
of any length are one class throughout, so a line in a third of all documents is one row of the
bands.  Paragraphs of MIN_WORDS words or more get a MinHash signature of their five-word shingles,
cut into bands that ``tuned`` chooses for a recall at the threshold.  Paragraphs that collide in a
band are compared exactly, in blocks (blocks.py), and linked at a Jaccard index of 0.8 or more.

A passage may also stand in the middle of a paragraph, between other sentences.  The sentences of
SENTENCE_WORDS words or more are therefore clustered too, by equality; those of removed paragraphs
take no part, those of paragraphs that stay do.  Passages at any word offset are those of passages.py.

Components of the links, and classes of equal paragraphs or sentences, are clusters; the first
occurrence, by (doc_id, row, first word), stays, the others are removals.  A unit counts if the run
of repeated units it stands in has RUN_WORDS words or more (fewer than GAP_WORDS other words don't
end a run): short lines that many documents share are no passage by themselves.

A unit is identified by 64 bits of its words' hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from . import shingles
from .blocks import block_of, block_pairs, compare
from .frames import bitmap_of, bounded_batches, discard, mapped, slices, stored
from .ngram_join import LISTS, batch_of
from .passages import passages, word_blocks
from .shingles import mix, shingles_at

WIDTH = 5
PERCENT = 80
RECALL = 0.995
ROWS = 3
MIN_WORDS = 12
SENTENCE_WORDS = 8
RUN_WORDS = 20
GAP_WORDS = 16
#: Paragraphs that a task remembers so as not to sign copies again; missing some only costs work.
REMEMBERED = 500_000


def tuned(threshold: float = PERCENT / 100, recall: float = RECALL, rows: int = ROWS) -> int:
    """The least number of bands of ``rows`` hashes that collide with probability ``recall`` at ``threshold``."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands


def signatures(elements: np.ndarray, starts: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each set (elements from its start to the next one's); keys of different bands differ.

    Elements are mixed hashes, so a multiplication by another odd number orders them anew.
    """
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), 0xA24BAED4963EE407 * (band + 1) & (1 << 64) - 1, np.uint64)
        for row in range(rows):
            odd = np.uint64(0x9FB21C651E98DF25 * (2 * (band * rows + row) + 1) & (1 << 64) - 1)
            key = mix(key + np.minimum.reduceat((elements ^ odd) * odd, starts))
        out[:, band] = key
    return out


def spans_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, level: int) -> np.ndarray:
    """Ids of runs of words, by their hashes and number."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * shingles._POW[: len(words)], out=total[1:])
    return mix(mix((total[ends] - total[starts]) * shingles._INV[starts] + (ends - starts).astype(np.uint64)) + np.uint64(level)).view(np.int64)


def paragraph_bounds(lines: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and last-plus-one of the paragraphs of a block of texts."""
    head = np.diff(lines, prepend=-1) != 0
    head[bounds[:-1][bounds[:-1] < len(lines)]] = True
    starts = np.flatnonzero(head)
    return starts, np.append(starts[1:], len(lines))


def gathered(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all places of the ranges, one range after another, and where each begins in them."""
    begin = np.cumsum(sizes) - sizes
    return np.repeat(starts - begin, sizes) + np.arange(sizes.sum()), begin


UNITS = "doc_id long,row long,level int,paragraph int,words int,at int,id long,keys array<long>"


def unit_table(docs: DataFrame, bands: int) -> DataFrame:
    """A row a unit: level 0 paragraphs, level 1 the sentences of those that have several; equal units of a level have equal ids.

    ``at`` is the words before it, ``keys`` the bands' keys, empty for sentences, short paragraphs
    and those that the task has met before.
    """
    names = [f.split()[0] for f in UNITS.split(",")]
    kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            docs, rows = batch.column(0), batch.column(1).to_numpy()
            for lo, words, lines, bounds, stops in word_blocks(batch.column(2).to_pylist()):
                if not len(words):
                    continue
                begin, end = paragraph_bounds(lines, bounds)
                ids, n = spans_of(words, begin, end, 0), end - begin
                new = [i for i in np.flatnonzero(n >= MIN_WORDS).tolist() if (x := int(ids[i])) not in seen and (len(seen) >= REMEMBERED or not seen.add(x))]
                counts, flat = np.zeros(len(ids), np.int32), np.empty(0, np.uint64)
                if new:
                    at, starts = gathered(begin[new], n[new] - WIDTH + 1)
                    flat = signatures(shingles_at(words, WIDTH)[at], starts, bands).ravel()
                    counts[new] = bands
                cut = stops.copy()
                cut[end - 1] = False  # a sentence that ends with its line doesn't divide it
                first = np.zeros(len(words) + 1, bool)
                first[begin] = True
                first[1:] |= cut
                s_begin = np.flatnonzero(first[:-1])
                s_end = np.append(s_begin[1:], len(words))
                of = np.searchsorted(begin, s_begin, "right") - 1
                keep = (np.bincount(of, minlength=len(begin))[of] > 1) & (s_end - s_begin >= SENTENCE_WORDS)
                s_begin, s_end = s_begin[keep], s_end[keep]
                a, b = np.concatenate([begin, s_begin]), np.concatenate([end, s_end])
                text = np.searchsorted(bounds, a, "right") - 1
                both = np.concatenate([ids, spans_of(words, s_begin, s_end, 1)])
                level = np.repeat([0, 1], [len(begin), len(s_begin)])
                offsets = np.concatenate([[0], np.cumsum(counts), np.full(len(s_begin), len(flat))]).astype(np.int32)
                plain = [rows[lo + text], level, lines[a], b - a, a - bounds[text], both]
                columns = [docs.take(pa.array(lo + text)), *[pa.array(x.astype(t.to_pandas_dtype()), t) for x, t in zip(plain, kinds[1:])], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(docs.select("doc_id", "row", "text"), run, UNITS)


def set_table(docs: DataFrame, active: DataFrame) -> DataFrame:
    """(id, elements) of the paragraphs in ``active`` (id); a bitmap of ids, 32 MB at most, keeps most others from being shuffled."""
    size, shared = bitmap_of(active)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in slices(batches):
            for _, words, lines, bounds, _ in word_blocks(batch.column(0).to_pylist()):
                begin, end = paragraph_bounds(lines, bounds)
                begin, end = begin[end - begin >= MIN_WORDS], end[end - begin >= MIN_WORDS]
                if not len(begin):
                    continue
                ids = spans_of(words, begin, end, 0)
                slot = ids & (size - 1)
                hit = [i for i in np.flatnonzero(table[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).tolist() if (x := int(ids[i])) not in seen and (len(seen) >= REMEMBERED or not seen.add(x))]
                if hit:
                    h = shingles_at(words, WIDTH)
                    yield batch_of([("id", ids[hit], pa.int64()), ("elements", [np.unique(h[begin[i] : end[i] - WIDTH + 1]).tobytes() for i in hit], pa.binary())])

    return mapped(docs.select("text"), run, "id long,elements binary").join(active, "id", "left_semi").dropDuplicates(["id"])


def near_links(docs: DataFrame, units: DataFrame) -> DataFrame:
    """(kind, a, b) of ``compare``: links that connect all paragraphs which banding brings together and which reach the threshold."""
    banded = units.where(F.size("keys") > 0).select(F.explode("keys").alias("key"), "id")
    groups = banded.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).where(F.col("low") < F.col("high"))
    large = groups.where(F.col("n") > 2).select("key", "low")
    ends = groups.where(F.col("n") == 2).select("key", F.explode(F.array("low", "high")).alias("id"), "low")
    entries = stored(ends.unionByName(banded.join(large, "key").select("key", "id", "low")).distinct(), "entries")
    owners = entries.groupBy("id").agg(F.min("low").alias("group"))
    members = stored(block_of(owners.withColumn("n", F.lit(32)), "group", "id", "n").select("id", "block"), "members")
    placed = entries.join(members, "id").select("key", "block").distinct()
    items = block_pairs(placed, "key")
    found = compare(items, members.withColumn("size", F.lit(1)), set_table(docs, members.select("id")), PERCENT)
    discard(entries, members)
    return found


def marked_units(docs: DataFrame) -> DataFrame:
    """The duplicate paragraphs and sentences of ``docs`` (doc_id, row, text): the words [at, till) of each, removed and, for paragraphs, exact (the one that stays is equal)."""
    table = stored(unit_table(docs, tuned()), "units")
    units = table.drop("keys")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "row", F.col("at").alias("unit"))
    again = F.row_number().over(Window.partitionBy("row", "at", "level").orderBy("id")) > 1
    lines, sentences = units.where("level = 0"), units.where("level = 1")
    count = (F.count("*").alias("n"), F.min(place).alias("first"))
    found = near_links(docs, table)
    near = components(found.where("kind = 0").select("a", "b"))
    concerned = lines.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id").unionByName(near.select(F.col("node").alias("id"))).distinct()
    repeated = stored(lines.join(concerned, "id", "left_semi"), "repeated")
    classes = repeated.groupBy("id").agg(*count)
    linked = near.join(classes, F.col("node") == F.col("id"))
    clusters = linked.groupBy("component").agg(F.sum("n").alias("size"), F.min("first").alias("keep"))
    linked = linked.join(clusters, "component").select("id", "size", "keep", (F.col("first") == F.col("keep")).alias("exact"))
    equal = classes.where(F.col("n") > 1).join(near.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.col("n").alias("size"), F.col("first").alias("keep"), F.lit(True).alias("exact"))
    paragraphs = stored(repeated.join(linked.unionByName(equal), "id").withColumn("removed", (place != F.col("keep")) | again), "paragraphs")
    # Sentences of lines that stay; the first filter leaves few rows to look up.
    several = sentences.join(sentences.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("id"), "id", "left_semi")
    staying = stored(several.join(paragraphs.where("removed").select("row", "paragraph").distinct(), ["row", "paragraph"], "left_anti"), "sentences")
    twice = staying.groupBy("id").agg(*count).where(F.col("n") > 1).select("id", F.col("n").alias("size"), F.col("first").alias("keep"), F.lit(True).alias("exact"))
    marked = paragraphs.unionByName(staying.join(twice, "id").withColumn("removed", (place != F.col("keep")) | again)).withColumn("till", F.col("at") + F.col("words"))
    order = Window.partitionBy("row").orderBy("at", F.desc("till"))
    before = marked.withColumn("_reach", F.coalesce(F.max("till").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-GAP_WORDS)))
    runs = before.withColumn("_run", F.sum(F.when(F.col("at") - F.col("_reach") >= GAP_WORDS, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = F.sum(F.greatest(F.lit(0), F.col("till") - F.greatest("at", "_reach"))).over(Window.partitionBy("row", "_run"))
    out = stored(runs.withColumn("_words", words).where(F.col("_words") >= RUN_WORDS).drop("_reach", "_run", "_words"), "listed")
    discard(table, found, repeated, paragraphs, staying)
    return out


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, row (64 bits of doc_id and text, so that rows of one doc_id and different texts are apart) and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("row"), "text")


def located_units(docs: DataFrame) -> DataFrame:
    """``duplicate_units`` of ``docs`` (doc_id, row, text), with row and till."""
    listed = marked_units(docs)
    gone = listed.where("level = 0 and removed").select("row", "at", "till", "exact")
    found = passages(docs, gone)
    # A passage counts if the units don't cover it: one that goes by units that go, one that stays by any.
    ranges = listed.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("at", "till"))).alias("any"), F.sort_array(F.collect_set(F.when(F.col("removed"), F.struct("at", "till")))).alias("cut"))
    reach = "aggregate(case when removed then cut else any end, word, (e, x) -> if(x.at <= e, greatest(e, x.till), e))"
    found = found.join(ranges, "row", "left").where(F.coalesce(F.expr(f"{reach} < till"), F.lit(True)))
    units = listed.select(
        "doc_id", "row", F.when(F.col("level") == 0, "paragraph").otherwise("sentence").alias("level"), F.col("at").alias("unit"), "paragraph", F.col("words").alias("n_words"),
        F.col("keep.doc_id").alias("cluster_doc_id"), F.col("keep.unit").alias("cluster_unit"), F.col("size").alias("cluster_size"), "removed", "till",
    )
    return units.unionByName(found.select(
        "doc_id", "row", F.lit("passage").alias("level"), F.col("word").alias("unit"), F.col("line").alias("paragraph"), (F.col("till") - F.col("word")).alias("n_words"),
        F.col("keep.doc_id").alias("cluster_doc_id"), F.col("keep.word").alias("cluster_unit"), F.col("size").alias("cluster_size"), "removed", "till",
    ))


def duplicate_units(docs: DataFrame) -> DataFrame:
    """The duplicate units of ``docs`` (doc_id, text).

    Columns doc_id, level (paragraph, sentence or passage), unit (the number of its first word in
    the document), paragraph (the line where it begins), n_words, cluster_doc_id and cluster_unit
    (the occurrence that stays), cluster_size and removed.  Null and empty texts have no units.
    Rows without doc_id count as before all others.  Repeated rows are duplicates of each other; of
    equal rows' units one stays.  Sentences of a paragraph that is removed are not listed, nor
    passages that listed units cover.  Long texts count whole; other columns are ignored, whatever
    their names.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    return located_units(identified(docs)).drop("row", "till")


WORD = re.compile(r"[^\t-\r ]+")


def without_words(piece: str, at: int, spans: list[tuple[int, int]]) -> str:
    """``piece`` without the words of ``spans``; its first word has number ``at``."""
    words = list(WORD.finditer(piece))
    for a, b in reversed(spans):
        a, b = max(a - at, 0), min(b - at, len(words))
        if a < b:
            piece = piece[: words[a].start()] + (piece[words[b].start() :] if b < len(words) else piece[words[b - 1].end() :])
    return piece


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same words in ranges that are apart, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of ``spans``, nor the lines that lose all theirs."""
    if text is None or not spans:
        return text
    lines, at, spans = [], 0, joined(spans)
    for line in text.split("\n"):
        n = len(WORD.findall(line))
        hit = [s for s in spans if s[0] < at + n and s[1] > at]
        if hit:
            line = without_words(line, at, hit)
        if not hit or WORD.search(line):
            lines.append(line)
        at += n
    return "\n".join(lines)


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with the removed units cut out of ``text`` (null texts stay null).

    Of equal rows the first keeps its text.  Rows are told apart by a number that they get when they
    are stored; a column of any name stays as it is.
    """
    bounded_batches(docs.sparkSession)
    own = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")), "documents")
    dup = located_units(own.select(F.col("doc.doc_id").cast("long").alias("doc_id"), "row", "doc.text")).where("removed").groupBy("row").agg(F.collect_set(F.struct("unit", "till")).alias("cut"))

    @F.pandas_udf("string")
    def left(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, [] if c is None else [(int(x["unit"]), int(x["till"])) for x in c]) for t, c in zip(texts, cuts)])

    shown = [F.col(f"doc.`{c}`") for c in docs.columns]
    return own.join(dup, "row", "left").withColumn("left", left(F.col("doc.text"), F.col("cut"))).select(*[F.col("left").alias(c) if c == "text" else x.alias(c) for c, x in zip(docs.columns, shown)])
