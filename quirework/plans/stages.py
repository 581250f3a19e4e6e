"""The stages of a run as plans from table to table."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STAGES, Layout, Settings, language_name
from ..functions.markup import to_markdown
from ..functions.text import n_paragraphs, n_tokens
from ..operators import assemble, classify, packing, segment, state
from ..sources import epub
from . import contents
from .tables import bounded_batches

#: What books that are made anew get as their style sheet.
STYLE = "body { line-height: 1.5; margin: 1em; }\nrt { font-size: 0.5em; }\n"


def extract(spark: SparkSession, path: str) -> DataFrame:
    return epub.documents(spark, path)


def clean(documents: DataFrame) -> DataFrame:
    """Documents with clean markdown, its tokens and paragraphs; those without markup are left out."""
    bounded_batches(documents.sparkSession)
    md = documents.where(F.col("raw").isNotNull()).withColumn("clean", to_markdown("raw"))
    return md.withColumns({"token_count": n_tokens(F.col("clean")), "paragraph_count": n_paragraphs(F.col("clean"))})


def classified(documents: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    given = "classification" if "classification" in documents.columns else None
    return classify.classify(documents, "raw", provider, given)


def chunked(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    docs = segment.eligible(segment.require_classified(documents, "classification"), "classification", s.chunking)
    keyed = docs.withColumn("_doc", F.struct("path", "spine_index"))
    chunks = segment.chunk_documents(keyed, "_doc", "clean", s.chunking)
    out = chunks.select("_doc.path", "_doc.spine_index", *[c for c in chunks.columns if c != "_doc"])
    return segment.with_chunk_ids(out, "spine_index")


def batched(chunks: DataFrame, s: Settings = Settings()) -> DataFrame:
    keyed = chunks.withColumn("_doc", F.struct("path", "spine_index"))
    b = packing.batches(keyed, "_doc", "chunk_index", "token_count", target=s.batching.target, least=s.batching.least, redistribute=s.batching.redistribute)
    return b.select("_doc.path", "_doc.spine_index", "batch_no", "first_item", "last_item", "token_count", packing.item_id(F.col("_doc.spine_index"), F.col("batch_no")).alias("item_id"))


def assembled(translations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents whose chunks are all translated; the others are deferred (complete is false)."""
    keyed = lambda df: df.withColumn("_doc", F.struct("path", "spine_index"))
    expected = keyed(chunks).groupBy("_doc").agg(F.count("*").alias("n"))
    out = assemble.assembled(keyed(translations), "_doc", "chunk_index", "translated_text", expected, "n")
    return out.select("_doc.path", "_doc.spine_index", "text", "complete")


def require_complete(whole: DataFrame) -> DataFrame:
    """``whole``, or an error that names up to ten documents that aren't assembled."""
    missing = whole.where(~F.col("complete")).select("path", "spine_index").orderBy("path", "spine_index").limit(10).collect()
    if missing:
        raise ValueError("not assembled: " + ", ".join(f"{r.path}#{r.spine_index}" for r in missing))
    return whole


def rebuilt(spark: SparkSession, path: str, whole: DataFrame, originals: DataFrame, s: Settings | None = None, titles: DataFrame | None = None) -> DataFrame:
    """(path, content) of each book with the assembled documents in place of its own, and vertical writing taken out of its style sheets.

    With settings the package names the target language, the suffix and a style sheet, to which the
    documents link; with ``titles`` (path, title, translated) the tables of contents are translated.
    """
    entries = epub.entries(spark, path)
    sheet = s.stylesheet if s else None

    def page(raw: str, body: str, opf: str, name: str) -> str:
        out = epub.with_body(raw, body)
        return epub.with_stylesheet(out, posixpath.relpath(epub.resolve(opf, sheet), posixpath.dirname(name) or ".")) if sheet else out

    names = F.udf(page, "string")
    docs = whole.where("complete").join(originals.select("path", "spine_index", "original_href", "raw"), ["path", "spine_index"])
    books = epub.books(spark, path).select("path", "opf_path")
    place = F.udf(epub.resolve, "string")
    placed = docs.join(books, "path").withColumn("name", place("opf_path", "original_href")).withColumn("body", assemble.to_html("text"))
    changed = placed.select("path", "name", names("raw", "body", "opf_path", "name").cast("binary").alias("content"))
    css = entries.where(F.col("name").endswith(".css")).select("path", "name", assemble.without_declarations(F.col("content").cast("string")).cast("binary").alias("content"))
    modified = changed.unionByName(css)
    if titles is not None:
        modified = modified.unionByName(contents.rewritten(entries, titles).join(changed.select("path", "name"), ["path", "name"], "left_anti"))
    if s is not None:
        language, suffix = s.target_language, s.suffix()
        package = F.udf(lambda opf: epub.package_updated(bytes(opf).decode("utf-8", "replace"), language, suffix, f"Translated to {language_name(language)}.", sheet).encode(), "binary")
        packages = entries.join(books, (entries["path"] == books["path"]) & (F.col("name") == F.col("opf_path"))).select(entries["path"], "name", package("content").alias("content"))
        added = books.select("path", place("opf_path", F.lit(sheet)).alias("name"), F.lit(STYLE).cast("binary").alias("content"))
        modified = modified.unionByName(packages).unionByName(added)
    return epub.rebuilt(entries, modified)


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, layout: Layout, stage: str) -> list[int]:
    """The versions of a stage's table that are written to the end, in order; others are not seen by readers."""
    done, fs = _folder(spark, f"{layout.stage(stage)}/v=*/_SUCCESS")
    return sorted(int(f.getPath().getParent().getName()[2:]) for f in fs.globStatus(done) or [])


def newest(spark: SparkSession, layout: Layout, stage: str) -> DataFrame:
    """The last whole version of a stage's table."""
    if not (known := versions(spark, layout, stage)):
        raise ValueError(f"{stage} has not run")
    return spark.read.parquet(layout.table(stage, known[-1]))


def invalidate(spark: SparkSession, layout: Layout, stage: str) -> tuple[str, ...]:
    """Delete the tables of the stages that use the output of ``stage``, and name them."""
    for name in state.invalidated(stage):
        folder, fs = _folder(spark, layout.stage(name))
        fs.delete(folder, True)
    return state.invalidated(stage)


def commit(df: DataFrame, layout: Layout, stage: str, version: int | None = None, items: DataFrame | None = None) -> DataFrame:
    """Write a version of a stage's table (the next one if none is named), then its state: a run that dies in between does the stage again."""
    spark = df.sparkSession
    if version is None:
        version = max(versions(spark, layout, stage), default=-1) + 1
    df.write.mode("overwrite").parquet(layout.table(stage, version))
    if items is not None:
        log = items.select(F.lit(stage).alias("stage"), F.col("item_id"), F.lit("completed").alias("status"), F.lit(version).cast("long").alias("at"), F.lit(None).cast("string").alias("error_message"), F.lit(version).cast("long").alias("seq"))
        log.write.mode("append").parquet(layout.log())
    return spark.read.parquet(layout.table(stage, version))


def downstream(stage: str) -> tuple[str, ...]:
    """Stages to run again after ``stage``."""
    return state.invalidated(stage) or STAGES[STAGES.index(stage) + 1 :]
