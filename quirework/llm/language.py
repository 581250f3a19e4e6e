"""Language identification by language-bitmask n-gram filters.

For each learned language the most frequent byte n-grams of its texts, the same number for
every language, go into a Bloom filter.  The filters are bit-sliced: slot i of one table holds
bit i of all languages' filters as a mask, so ANDing the masks of an n-gram's slots gives all
languages that contain it at once.  A text's hits are counted by language; with f the share of
set bits in a language's filter and k hashes, n windows give n * f**k hits by chance, and
(hits - n * f**k) / (1 - f**k) is the estimate that decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .frames import arrow_types, bounded_batches, mapped, slices
from .grams import normal, slot, sums, windows

WIDTH = 5
HASHES = 3
SLOT_BITS = 20
#: Bounds of training: rows sampled of each language (by a hash of doc_id and text), and n-grams a language.
SAMPLE_ROWS = 20_000
GRAMS = 30_000
#: Languages whose bits share one table.
BANK = 64
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")


class Filters:
    """Bit-sliced Bloom filters: for each BANK languages a table of 2**SLOT_BITS slots (8 MB at most), so the size follows the languages and not the corpus."""

    def __init__(self, languages: list[str], grams: list[np.ndarray]):
        self.languages, self.tables, fill = languages, [], []
        for low in range(0, max(1, len(languages)), BANK):
            part = grams[low : low + BANK]
            kind = next(k for k, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if len(part) <= n)
            table = np.zeros(1 << SLOT_BITS, kind)
            for bit, keys in enumerate(part):
                for which in range(HASHES):
                    table[slot(keys, which, SLOT_BITS)] |= kind(1 << bit)
            self.tables.append(table)
            fill += [np.mean(table >> kind(b) & kind(1)) for b in range(len(part))]
        self.chance = np.array(fill) ** HASHES

    def masks(self, keys: np.ndarray, bank: int = 0) -> np.ndarray:
        """For each n-gram the languages of a bank whose filters contain it."""
        out = self.tables[bank][slot(keys, 0, SLOT_BITS)]
        for which in range(1, HASHES):
            out &= self.tables[bank][slot(keys, which, SLOT_BITS)]
        return out

    def estimates(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected hits by text and language, and the windows of each text."""
        keys, starts, ends = windows(parts, WIDTH)
        n, hits = (ends - starts).astype(float), []
        for bank in range(len(self.tables)):
            masks = self.masks(keys, bank)
            hits += [sums(masks >> masks.dtype.type(b) & masks.dtype.type(1), starts, ends) for b in range(min(BANK, len(self.languages) - bank * BANK))]
        return np.clip((np.stack(hits, 1) - n[:, None] * self.chance) / (1 - self.chance), 0, None), n

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and coverage of each text."""
        if not self.languages:
            return [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        estimates, n = self.estimates([normal(t) for t in texts])
        best = estimates.argmax(1)
        top = estimates[np.arange(len(best)), best]
        total = estimates.sum(1)
        out = []
        for t, b, x, s, w in zip(texts, best.tolist(), top.tolist(), total.tolist(), n.tolist()):
            known = t is not None and LETTER.search(t)
            out.append((self.languages[b], x / s if s else 1 / len(self.languages), min(1.0, x / w)) if known else (UNDETERMINED, 0.0, 0.0))
        return out


def train(labelled: DataFrame) -> Filters:
    """Filters from the text and lang of ``labelled`` (doc_id, text, lang); rows without text or lang don't count.

    All languages are learned.  Of each up to about SAMPLE_ROWS rows are used, all rows of a rarer
    one, drawn by a hash of doc_id and text.  Languages are in order of their rows, so that ties
    fall to the more frequent one.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in counts]
    if not languages:
        return Filters([], [])
    bound = {r["lang"]: int(SAMPLE_ROWS / r["count"] * (1 << 30)) for r in counts if r["count"] > SAMPLE_ROWS}
    number = {x: i for i, x in enumerate(languages)}

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lang = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()], np.int64)
            keys, starts, ends = windows([normal(x) for x in batch.column(0).to_pylist()], WIDTH)
            where = np.repeat(lang, ends - starts)
            inside = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
            tagged, n = np.unique((where[where >= 0].astype(np.uint64) << np.uint64(8 * WIDTH)) | keys[inside[where >= 0]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tagged.astype(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    if bound:
        limits = F.create_map(*(F.lit(x) for pair in bound.items() for x in pair))
        rows = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.coalesce(F.element_at(limits, F.col("lang")), F.lit(1 << 30)))
    sample = rows.select("text", "lang")
    counted = mapped(sample, grams, "key long,n long").groupBy("key").agg(F.sum("n").alias("n")).withColumn("lang", F.shiftright("key", 8 * WIDTH))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "key")
    kept = counted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= GRAMS).select("key").toArrow()["key"].to_numpy()
    low = np.int64((1 << 8 * WIDTH) - 1)
    return Filters(languages, [(kept[kept >> (8 * WIDTH) == i] & low).astype(np.uint64) for i in range(len(languages))])


def identify(docs: DataFrame, filters: Filters, *keep: Column | str) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score and coverage.

    lang_pred is ``und`` (scores 0) where the text is null or has no letter.  score is the winner's
    part of all languages' corrected hits, coverage its corrected hits by the text's n-grams; of
    equal estimates the first language's counts.  Whole texts count; equal texts get equal values;
    repeated rows stay; an empty table gives no rows.  Columns named like the three new ones are best
    kept inside a struct.
    """
    out = docs.select(*keep, F.col("text"))
    schema = StructType([*out.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("coverage", DoubleType())])
    names = schema.names
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    kinds = arrow_types("a string,b double,c double")
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            found = [pa.array(c, t) for c, t in zip(zip(*model.predict(batch.column(batch.num_columns - 1).to_pylist())), kinds)]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + found, names=names)

    return mapped(out, run, schema)
