"""Repeated passages at any word offset: all windows of WINDOW words that occur at several places.

Of the word n-grams (GRAM words) in a window the one with the least hash stands for the window.
Equal windows have equal ones, and neighbouring windows mostly share theirs, so about one n-gram
in 13 is counted instead of all windows.  Only windows whose n-gram occurs again are hashed as a
whole and grouped; no window that repeats is lost.

A window's first occurrence, by (doc_id, row, word), stays, the others are removals; windows of a
kind that overlap or touch are chained into maximal passages.  Lines that are removed anyway don't take
part: windows inside one are left out, and also those that only touch a line which goes for the sake
of a similar one (its words are not repeated elsewhere for certain).  So each removed word leads, over
strictly earlier copies, to one that stays.

A window's place is one number, its text's number in the order of (doc_id, row) and then its word, so
that a row of the shuffles is a hash, a place and a line, and first occurrences are least numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .frames import bitmap_of, collected, discard, mapped, slices, stored
from .ngram_join import batch_of

WINDOW = 50
GRAM = 25
REACH = WINDOW - GRAM + 1
#: Bits of a place that tell the word: a text has fewer than 2**31 bytes, so at most 2**30 words.  The others number 2**33 texts.
WORD_BITS = 30


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; ``words`` come from ``word_hashes``, so that its powers suffice."""
    n = max(0, len(words) - width + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * shingles._POW[: len(words)], out=total[1:])
    return shingles.mix((total[width : width + n] - total[:n]) * shingles._INV[:n])


def extreme(values: np.ndarray, width: int, of=np.minimum) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = of(values[: max(0, len(values) - step)], values[step:])
        have += step
    return values


ENDS = np.isin(np.arange(256), [ord(c) for c in ".!?"])
BLANK = np.isin(np.arange(256), [ord(c) for c in " \t"])


def word_blocks(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts: number of the first, hashes and line numbers (within the text) of all words, first word of each text (and the end), and whether a sentence ends with the word and the line goes on after a blank."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    for lo, hi in shingles.blocks(data):
        part, offsets = np.frombuffer(b"\n".join(data[lo:hi]) + b"\n", np.uint8), np.cumsum([0] + [len(t) + 1 for t in data[lo:hi]])
        words, start, end = shingles.word_hashes(part)
        bounds, breaks = np.searchsorted(start, offsets), np.cumsum(np.concatenate([[0], part == 10]))
        stops = ENDS[part[end - 1]] & BLANK[part[end]]
        yield lo, words, breaks[start] - np.repeat(breaks[offsets[:-1]], np.diff(bounds)), bounds, stops


def windows_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram hashes, each window's least one, and whether the window is within one text."""
    grams = rolling(words, GRAM)
    least = extreme(grams, REACH)
    return grams, least, np.arange(len(least)) + WINDOW <= np.repeat(bounds[1:], np.diff(bounds))[: len(least)]


def anchors(docs: DataFrame) -> DataFrame:
    """(id): the n-grams that stand for windows and occur at several places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, words, _, bounds, _ in word_blocks(batch.column(0).to_pylist()):
                grams, least, inside = windows_of(words, bounds)
                if inside.any():
                    edge = np.zeros(REACH - 1, np.uint64)
                    most = extreme(np.concatenate([edge, np.where(inside, least, np.uint64(0)), edge]), REACH, np.maximum)
                    found, n = np.unique(grams[most == grams], return_counts=True)
                    yield batch_of([("id", found.view(np.int64), pa.int64()), ("n", n.astype(np.int64), pa.int64())])

    return mapped(docs.select("text"), run, "id long,n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("id")


def candidate_windows(docs: DataFrame) -> DataFrame:
    """A row a text with windows whose n-gram occurs again: doc_id, row, and packed the runs of such windows, the first words and numbers of the lines, and the windows' hashes."""
    size, shared = bitmap_of(anchors(docs))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in slices(batches):
            ids, rows, texts = (c.to_pylist() for c in batch.columns)
            for lo, words, lines, bounds, _ in word_blocks(texts):
                _, least, inside = windows_of(words, bounds)
                if not inside.any():
                    continue
                slot = (least & np.uint64(size - 1)).astype(np.int64)
                take = np.flatnonzero(inside & (table[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool))
                whole, ends = rolling(words, WINDOW), np.searchsorted(take, bounds)
                out = []
                for k in np.flatnonzero(np.diff(ends)).tolist():
                    a, here = bounds[k], take[ends[k] : ends[k + 1]]
                    first = np.flatnonzero(np.diff(here, prepend=-2) != 1)
                    runs = np.stack([here[first] - a, np.diff(np.append(first, len(here)))]).astype(np.int32)
                    heads = np.flatnonzero(np.diff(lines[a : bounds[k + 1]], prepend=-1))
                    out.append((ids[lo + k], rows[lo + k], runs.tobytes(), np.stack([heads, lines[a + heads]]).astype(np.int32).tobytes(), whole[here].tobytes()))
                if out:
                    yield batch_of([(n, c, t) for n, c, t in zip(["doc_id", "row", "runs", "heads", "h"], zip(*out), [pa.int64()] * 2 + [pa.binary()] * 3)])

    return mapped(docs.select("doc_id", "row", "text"), hashed, "doc_id long,row long,runs binary,heads binary,h binary")


def numbered(texts: DataFrame) -> DataFrame:
    """(doc_id, row, owner, number): the rows of ``texts`` numbered from 0 by (owner, row); owner is doc_id, or the least number where that is null."""
    own = texts.groupBy("row").agg(F.min("doc_id").alias("doc_id")).withColumn("owner", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # the id of a row in order is its partition's number, 33 bits for its place there
    table = stored(own.repartitionByRange("owner", "row").sortWithinPartitions("owner", "row").withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "texts")
    totals = table.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    base = totals.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return table.join(F.broadcast(base), "_part").select("doc_id", "row", "owner", (F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_base")).alias("number"))


def dealt_windows(blobs: DataFrame, numbers: DataFrame, gone: DataFrame) -> DataFrame:
    """(h, place, line) of the windows in ``blobs``, without those that a removed line of ``gone`` (row, at, till, exact) excludes."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for number, runs, heads, h, cut in zip(*(c.to_pylist() for c in batch.columns)):
                (start, n), (head, line) = np.frombuffer(runs, np.int32).reshape(2, -1), np.frombuffer(heads, np.int32).reshape(2, -1)
                at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
                keep = np.ones(len(at), bool)
                for c in cut or []:
                    # an equal line: windows inside; a similar one: windows that touch it
                    low, high = (c["at"], c["till"] - WINDOW) if c["exact"] else (c["at"] - WINDOW + 1, c["till"] - 1)
                    keep[np.searchsorted(at, low) : max(np.searchsorted(at, low), np.searchsorted(at, high, "right"))] = False
                if keep.any():
                    at = at[keep]
                    where = line[np.searchsorted(head, at, "right") - 1]
                    yield batch_of([("h", np.frombuffer(h, np.int64)[keep], pa.int64()), ("place", (number << WORD_BITS) + at.astype(np.int64), pa.int64()), ("line", where, pa.int32())])

    cut = gone.groupBy("row").agg(F.collect_set(F.struct("at", "till", "exact")).alias("cut"))
    rows = blobs.join(numbers.select("row", "number"), "row").join(cut, "row", "left")
    return mapped(rows.select("number", "runs", "heads", "h", "cut"), dealt, "h long,place long,line int")


def passages(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Maximal passages of repeated windows of ``docs`` (doc_id, row, text).

    Columns doc_id, row, word and till (the words of the text, from 0, till excluded), line, removed,
    keep (place of the first window's first occurrence) and size (occurrences of its most frequent window).
    """
    blobs = stored(candidate_windows(docs), "texts_with_windows")
    numbers = numbered(blobs)
    found = stored(dealt_windows(blobs, numbers, gone), "windows")
    discard(blobs)
    collected(docs.sparkSession, 0)
    classes = found.groupBy("h").agg(F.count("*").alias("n"), F.min("place").alias("keep")).where(F.col("n") > 1)
    marked = found.join(classes, "h").withColumn("number", F.shiftright("place", WORD_BITS)).withColumn("removed", F.col("place") != F.col("keep"))
    order = Window.partitionBy("number", "removed").orderBy("place")
    gap = F.when(F.col("place") - F.lag("place").over(order) <= WINDOW, 0).otherwise(1)
    runs = marked.withColumn("_gap", gap).withColumn("_run", F.sum("_gap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = F.min(F.struct("place", "line", "keep"))
    spans = runs.groupBy("number", "removed", "_run").agg(first.alias("f"), F.max("place").alias("last"), F.max("n").alias("size"))
    word = lambda c: F.col(c).bitwiseAND((1 << WORD_BITS) - 1).cast("int")
    spans = spans.select("number", word("f.place").alias("word"), (word("last") + WINDOW).alias("till"), F.col("f.line").alias("line"), "removed", F.shiftright("f.keep", WORD_BITS).alias("_kept"), word("f.keep").alias("_word"), "size")
    kept = numbers.select(F.col("number").alias("_kept"), F.col("owner").alias("_doc"), F.col("row").alias("_row"))
    keep = F.struct(F.col("_doc").alias("doc_id"), F.col("_row").alias("row"), F.col("_word").alias("word")).alias("keep")
    return spans.join(numbers.select("number", "doc_id", "row"), "number").join(kept, "_kept").select("doc_id", "row", "word", "till", "line", "removed", keep, "size")
