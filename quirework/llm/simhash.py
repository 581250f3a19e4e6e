"""Document fingerprints: SimHash by DataFrame functions alone.

Each occurrence of a term (a run without white space, lower-cased) votes with its hash: for a set
bit with +weight, else with -weight, the weight being the square of the term's length, up to
MAX_LENGTH, so that short common words matter little.  The
fingerprint has a bit where the votes are positive.  Two bits' positive votes are summed in the
two halves of one 64-bit sum, so 32 sums and the total weight decide all 64 bits.

Search: with ``blocks`` bit blocks and radius r, two fingerprints within r agree on at least
blocks - r whole blocks, so each choice of so many blocks is a table keyed by the bits in them,
and pairs that meet in a table are verified.  A pair counts in the first table that joins it.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored

MAX_LENGTH = 12
RADIUS = 3
BLOCKS = 6
#: Documents of a bucket of neighbours, about, and buckets at most; their bounds pass through the driver.
BUCKET_ROWS = 500
MAX_BUCKETS = 1 << 16
LANES = 0x1_0000_0001
SPACES = r"[\s\x{85}\x{A0}\x{3000}]+"


def votes(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp`` (long) for each group of equal keys, from all its texts."""
    terms = texts.select(*keys, F.explode(F.split(F.lower(text), SPACES)).alias("_term"))
    weighed = terms.select(*keys, F.xxhash64("_term").alias("_h"), F.least(F.length("_term"), F.lit(MAX_LENGTH)).cast("long").alias("_n")).withColumn("_w", F.col("_n") * F.col("_n"))
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(LANES)) * F.col("_w")).alias(f"_v{i}") for i in range(32)]
    summed = weighed.groupBy(*keys).agg(*sums, F.sum("_w").alias("_w"))
    half = F.expr("_w div 2")
    bit = lambda i: F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")
    low = [F.when(F.col(f"_v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) > half, bit(i)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    high = [F.when(F.shiftrightunsigned(f"_v{i}", 32) > half, bit(i + 32)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    fp = reduce(lambda a, b: a.bitwiseOR(b), low + high)
    return summed.select(*keys, fp.cast("long").alias("fp"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / 64


def as_hex(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def place(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value`` (0 for null): found in two steps, over every n-th bound and the n after it."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    at = F.size(F.filter(longs([r[0] for r in runs]), lambda b: b <= value))
    inner = F.array(*[longs(r) for r in runs])
    return F.when(at > 0, (at - 1) * step + F.size(F.filter(F.element_at(inner, at), lambda b: b <= value))).otherwise(0)


def with_next(docs: DataFrame) -> DataFrame:
    """Buckets of documents that follow each other by descending doc_id, each closed by a copy of the next bucket's first one.

    Columns bucket, seq (the order in it), ghost (a closing copy), doc_id, text and next_text.  Rows
    of equal doc_id follow each other by a hash of their text; rows without doc_id come last.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = min(MAX_BUCKETS, -(-ids.count() // BUCKET_ROWS))
    bounds = (ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 10 * n)).alias("b")).first()["b"] or []) if n > 1 else []
    bounds = sorted(set(bounds))
    tops = ids.select(place(F.col("doc_id"), bounds).alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()
    follow = [(t["bucket"], tops[i - 1]["top"]) for i, t in enumerate(tops) if tops[i - 1]["top"] is not None]  # one row a bucket; the lowest is followed by the highest
    ghosts = F.broadcast(spark.createDataFrame(follow, "ghost_of int, doc_id long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    real = rows.select(place(F.col("doc_id"), bounds).alias("bucket"), F.lit(False).alias("ghost"), "doc_id", "text")
    both = real.unionByName(rows.join(ghosts, "doc_id").select(F.col("ghost_of").alias("bucket"), F.lit(True).alias("ghost"), "doc_id", "text"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc("doc_id"), F.xxhash64("text"))
    return both.select("bucket", "ghost", "doc_id", "text", F.row_number().over(order).alias("seq"), F.lead("text").over(order).alias("next_text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, in one shuffle of the texts.

    The edited text has its last floor(n/2) code points replaced by the first as many (or all) of
    the next document's.  A null text counts as empty; an empty text's fingerprint is 0.  Repeated
    rows stay.  Returns doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp.
    """
    half = F.expr("length(text) div 2")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.coalesce(F.col("next_text").substr(F.lit(1), half), F.lit("")))
    rows = with_next(docs).select("bucket", "seq", "ghost", "doc_id", "text", F.when(F.col("ghost"), F.lit("")).otherwise(edited).alias("edited"))
    facts = [F.first(c).alias(c) for c in ("ghost", "doc_id", "n_chars", "edited_sha256")]
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("_k")
    base = rows.select("bucket", "seq", "ghost", "doc_id", F.length("text").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), kinds)
    keys = ["bucket", "seq", "kind", "ghost", "doc_id", "n_chars", "edited_sha256"]
    voted = votes(base.select(*[c for c in keys if c != "kind"], "_k.kind", "_k.t"), keys, "t")
    pair = voted.groupBy("bucket", "seq").agg(*facts, F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    out = pair.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("seq")))
    return out.where(~F.col("ghost")).select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", F.coalesce("next_fp", F.lit(0).cast("long")).alias("next_fp"))


def masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """A mask for each table: all choices of blocks - radius of the bit blocks, as signed 64-bit numbers."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    out = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def within_radius(queries: DataFrame, rows: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """All pairs (query_fp, fp, distance, n) with a distance of at most ``radius``; n rows have that fp.

    ``queries`` and ``rows`` have a column fp; equal fingerprints are one entry, so a group of
    copies is one entry of each table.  Exact: no pair within the radius is missed.
    """
    tables = masks(blocks, radius)
    listed = lambda c: F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(c).bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(tables)]))
    entries = rows.where(F.col("fp").isNotNull()).groupBy("fp").agg(F.count("*").alias("n")).select("fp", "n", listed("fp").alias("_e")).select("fp", "n", "_e.*")
    asked = queries.where(F.col("fp").isNotNull()).select(F.col("fp").alias("query_fp")).distinct()
    probes = asked.select("query_fp", listed("query_fp").alias("_e")).select("query_fp", "_e.*")
    differ = F.col("fp").bitwiseXOR(F.col("query_fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(tables)])
    met = probes.join(entries, ["t", "key"]).where((F.bit_count(differ) <= radius) & (first == F.col("t")))
    return met.select("query_fp", "fp", F.bit_count(differ).alias("distance"), "n")


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_docs.

    near_docs is the number of documents within RADIUS of this one's fingerprint, itself included,
    for the query set (doc_id divisible by 100); null for other documents.
    """
    table = stored(fingerprints(docs), "fingerprints")
    query = F.col("doc_id") % 100 == 0
    found = within_radius(table.where(query), table).groupBy("query_fp").agg(F.sum("n").alias("near_docs"))
    shown = [F.col("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), F.col("edited_sha256"), as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"), likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next")]
    asked = table.where(query).join(found, F.col("fp") == F.col("query_fp"), "left").select(*shown, "near_docs")
    rest = table.where(F.coalesce(~query, F.lit(True))).select(*shown, F.lit(None).cast("long").alias("near_docs"))
    return asked.unionByName(rest)
