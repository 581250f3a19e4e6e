"""Text columns: token counts, white space, headings, identifiers."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space that a strip removes, and the tokens that the default counter counts.
BLANK = r"[ \t\n\x0B\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = "A-Za-z0-9À-ɏ"
TOKEN = rf"[{WORD}]+|[^\s{WORD}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def rstrip_lines(c: Column) -> Column:
    return F.regexp_replace(c, r"[ \t\x0B\f\r\x{A0}\x{3000}]+(?=\n|$)", "")


def n_tokens(c: Column, pattern: str = TOKEN) -> Column:
    """Tokens of the default counter: runs of letters and digits, and other characters one by one."""
    if pattern != TOKEN:
        return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))
    # what is left when each run is one letter and white space is gone: no list of all tokens is made
    left = F.regexp_replace(c, f"[{WORD}]{{2,}}+", "a")
    return F.coalesce(F.length(reduce(lambda x, blank: F.replace(x, F.lit(blank), F.lit("")), " \t\n\x0b\f\r", left)), F.lit(0))


def truncated_tokens(c: Column, n: int, pattern: str = TOKEN) -> Column:
    """The text up to and with its n-th token."""
    return F.when(n_tokens(c, pattern) <= n, c).otherwise(F.regexp_extract(c, rf"(?s)^((?:\s*(?:{pattern})){{0,{n}}})", 1))


def normal_markdown(c: Column) -> Column:
    """At most one blank line in a row, no space at line ends, one newline at the end."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"[ \t\x0B\f\r\x{A0}\x{3000}]+(?=\n|$)", "")
    return F.concat(strip(lines), F.lit("\n"))


def n_paragraphs(c: Column) -> Column:
    return F.size(F.filter(F.split(c, "\n\n"), lambda p: F.length(strip(p)) > 0))


def truncated_words(c: Column, n: int) -> Column:
    """Longer texts are cut at the last space within n characters and get three dots."""
    cut = F.regexp_replace(F.substring(c, 1, n), " [^ ]*$", "")
    return F.when(F.length(c) > n, F.concat(cut, F.lit("..."))).otherwise(c)


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def slug(c: Column) -> Column:
    """An identifier: compatibility form, lower case, other than word characters become single hyphens."""
    word = F.regexp_replace(F.lower(nfkc(c)), r"(?U)[^\w]+", "-")
    out = F.regexp_replace(F.regexp_replace(word, "-+", "-"), "^-+|-+$", "")
    return F.when(F.length(out) > 0, out).otherwise("unknown")


def book_id(isbn: Column, title: Column, stem: Column) -> Column:
    """ISBN (10 or 13 digits) if there is one, else the title's slug, else the file name's."""
    digits = F.regexp_replace(isbn, "[^0-9Xx]", "")
    valid = F.upper(F.regexp_extract(digits, r"^(97[89][0-9]{10}|[0-9]{9}[0-9Xx])$", 1))
    return F.when(F.length(valid) > 0, valid).when(F.length(strip(F.coalesce(title, F.lit("")))) > 0, slug(title)).otherwise(slug(stem))


def pad_width(n: Column) -> Column:
    return F.greatest(F.lit(4), F.length(n.cast("string")))


def chunk_id(spine: Column, chunk: Column, width: int = 4) -> Column:
    return F.format_string(f"%0{width}d.%03d", spine, chunk)


def parse_chunk_id(c: Column) -> Column:
    parts = F.split(c, "[.]")
    return F.struct(F.get(parts, F.lit(0)).cast("int").alias("spine_index"), F.get(parts, F.lit(1)).cast("int").alias("chunk_index"))
