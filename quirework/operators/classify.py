"""Rules that classify a document from its markup; what they leave open goes to a text provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import n_tokens, strip

HEADING = r"(?is)<(h[1-6])\b[^>]*>(.*?)</\1>"
# Fixed value: the classes a document can have.
CLASSES = ("chapter", "frontmatter", "backmatter", "toc_authored", "toc_auto", "illustration", "unknown")


def without_tags(html: Column) -> Column:
    """Tags go; text of scripts, styles and the title stays."""
    return F.regexp_replace(html, "<[^>]+>", "")


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"[\s\x{A0}\x{3000}]+", " "))


def headings(html: Column) -> Column:
    """Texts of h1 to h6 in document order, empty ones left out."""
    found = F.regexp_extract_all(html, F.lit(HEADING), F.lit(2))
    return F.filter(F.transform(found, lambda h: collapsed(without_tags(h))), lambda h: F.length(h) > 0)


def visible_text(html: Column) -> Column:
    return collapsed(without_tags(html))


def text_without_headings(html: Column) -> Column:
    return visible_text(F.regexp_replace(html, HEADING, " "))


def n_words(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, " ")))


def by_rules(html: Column, most_tokens: int = 30, most_words: int = 10) -> Column:
    """struct<classification, title> of the first rule that holds, else null.

    A table of contents marked as such; an image with few tokens of text; headings with few
    words besides.
    """
    titles = headings(html)
    answer = lambda kind, title: F.struct(F.lit(kind).alias("classification"), title.cast("string").alias("title"))
    toc = html.rlike(r"(?i)epub:type\s*=\s*[\"']toc[\"']")
    picture = (n_tokens(visible_text(html)) < most_tokens) & html.rlike(r"(?i)<img\b")
    bare = (F.size(titles) > 0) & (n_words(text_without_headings(html)) < most_words)
    return F.when(toc, answer("toc_auto", F.lit("Table of Contents"))).when(picture, answer("illustration", F.lit(None))).when(bare, answer("frontmatter", F.get(titles, F.lit(0))))


def classify(docs: DataFrame, html: str, provider=None, given: str | None = None) -> DataFrame:
    """``docs`` with classification and title: what is given stays, then rules, then the provider.

    The provider (a function from DataFrame to DataFrame with a column answer) is called for the
    rows that are left, in a branch of its own: a CASE would call it for all rows.
    """
    ruled = docs.withColumn("_rule", by_rules(F.col(html)))
    kept = F.col(given) if given else F.lit(None).cast("string")
    out = ruled.withColumn("_class", F.coalesce(kept, F.col("_rule.classification"))).withColumn("_title", F.col("_rule.title"))
    done = out.where(F.col("_class").isNotNull())
    rest = out.where(F.col("_class").isNull())
    if provider is not None:
        rest = provider(rest).withColumn("_class", F.when(F.col("answer").isin(*CLASSES), F.col("answer"))).drop("answer")
    both = done.unionByName(rest.select(*done.columns))
    drop = [c for c in ("classification", "title") if c in docs.columns and c != html]
    return both.drop("_rule", *drop).withColumnsRenamed({"_class": "classification", "_title": "title"})
