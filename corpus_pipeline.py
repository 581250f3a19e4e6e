"""A corpus from raw documents to token ids, in five stages, each written as Parquet and read again.

1. language: documents without text, without a letter, or in none of the learned languages go.
2. near_duplicates: of each group of documents with similar word shingles the one with the smallest doc_id stays, whatever rows share a doc_id or have none.
3. pii: personal data becomes pseudonyms.
4. mixing: documents are taken so often that sources have their target weights.
5. encoding: texts become token ids, of which counts and hashes are returned.

Each stage begins by having the executors collect their garbage, so that it has the memory which the stage before took.
All stages but the last return the columns of their documents, whatever other columns there are and
however they are named.  An empty table goes through as one.  Long texts count whole.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from quirework.llm import byte_bpe, language, mixing, ngram_join, pii
from quirework.llm.frames import documents, executors_collected, stored
from quirework.llm.queries import EXAMPLE_KEY

#: Shingles of five words, and a Jaccard index of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Part of a text's n-grams that its language must know.
LEAST_COVERAGE = 0.25
#: The encoder remembers this part of what it would by itself: earlier stages have left the executors less memory.
ENCODER_SHARE = 0.3


def whole(docs: DataFrame):
    """All columns as one, so that no name clashes with what a stage adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def with_room(stage):
    """The stage, begun with executors that hold no garbage of the one before."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        executors_collected(spark)
        return stage(spark, docs, sf_dir)

    return run


@with_room
def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents of a learned language; learns from the stage's own documents that name one.

    A null text, an empty one and one without a letter go; a null lang or doc_id doesn't matter.
    Repeated rows are treated alike, ties fall to the more frequent language.
    """
    filters = language.train(docs.select("doc_id", "text", "lang"))
    found = language.identify(docs, filters, whole(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("coverage") >= LEAST_COVERAGE)).select("doc.*")


@with_room
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the one with the smallest doc_id and, of several, the smallest hash of all columns.

    Rows without doc_id stay only where no row of the component has one.  Null texts and texts without
    words are linked with nothing, but equal rows are one.
    """
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    rows = docs.select(whole(docs), F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64(*plain).alias("row"))
    groups = ngram_join.join_documents(rows.select(F.col("row").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).select(F.col("doc_id").alias("row"), "component_id").distinct()
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    keep = rows.select("id", "row").distinct().join(groups, "row").groupBy("component_id").agg(first).select("first.row")
    return rows.join(keep, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")


@with_room
def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and n_chars after it; a null text stays null."""
    out = pii.pseudonymise(docs.select(whole(docs), "text"), EXAMPLE_KEY)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("text"), "n_chars": chars}
    return out.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


@with_room
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, null texts have no tokens."""
    return mixing.mix(docs.select(whole(docs), "doc_id", "source", "text")).select("doc.*")


@with_room
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of ids and decoded bytes, for each row; a null text has no ids."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ENCODER_SHARE)


STAGES = [("language", by_language), ("near_duplicates", without_near_duplicates), ("pii", with_pseudonyms), ("mixing", mixed), ("encoding", encoded)]

#: Lookbehind patterns, hashes and trained filters have no SQL that both engines run; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name, "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
