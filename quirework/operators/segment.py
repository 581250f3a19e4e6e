"""Segmentation: markdown into blocks, blocks into token-budgeted chunks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANK, chunk_id, n_tokens

# Paragraphs that mark a change of scene, and the classes of documents that are cut into chunks.
SCENE_BREAKS = (
    r"^\s*[\*]{3,}\s*$",
    r"^\s*[◇]{3,}\s*$",
    r"^\s*[＊]{3,}\s*$",
    r"^\s*[・]{3,}\s*$",
    r"^\s*[×](\s*[×])+\s*$",
    r"^\s*[─]{4,}\s*$",
    r"^\s*\*\s+\*\s+\*\s*$",
)
CHUNKABLE = ("chapter", "frontmatter", "backmatter", "toc_authored", "toc_auto")
HR = r"^\s*[-*_](?:\s*[-*_]){2,}\s*$"
MARK = "\u0001"


@dataclass(frozen=True)
class Chunking:
    target: int = 2000
    most: int = 2400
    least: int = 400
    flex: float = 0.2
    scene_breaks: tuple[str, ...] = SCENE_BREAKS
    normal_break: str | None = "* * *"
    chunkable: tuple[str, ...] = field(default=CHUNKABLE)


def block_array(text: Column, c: Chunking = Chunking()) -> Column:
    """array<struct<kind, text>> of a markdown text, in order.

    Boundaries are marked by regular expressions and the text is split at the marks, so a document
    is one row throughout and nothing is shuffled.  Headings and rules are blocks of their own.
    """
    lines = F.regexp_replace(text, f"{BLANK[:-1].replace(chr(92) + 'n', '')}]+(?=\n|$)", "")
    within = r"[ \t\x0B\f\r\x{A0}\x{3000}]*"  # never over the end of a line
    own = F.regexp_replace(lines, rf"(?m)^({within}#.*|{within}[-*_](?:{within}[-*_]){{2,}}{within})$", f"{MARK}$1{MARK}")
    parts = F.split(F.regexp_replace(own, "\n{2,}", MARK), f"\n?{MARK}+\n?")
    blocks = F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^\n+|\n+$", "")), lambda p: p.rlike(f"[^{BLANK[1:]}"))
    scene = scene_pattern(c.scene_breaks)

    def kind(p: Column) -> Column:
        base = F.when(p.rlike(f"^{BLANK}*#"), "heading").when(p.rlike(HR), "hr")
        return (base.when(p.rlike(scene), "scene_break") if scene else base).otherwise("paragraph")

    def block(b: Column) -> Column:
        shown = F.when(b["kind"].isin("hr", "scene_break"), c.normal_break).otherwise(b["text"]) if c.normal_break is not None else b["text"]
        return F.struct(b["kind"].alias("kind"), shown.alias("text"))

    return F.transform(F.transform(blocks, lambda p: F.struct(kind(p).alias("kind"), p.alias("text"))), block)


def scene_pattern(patterns: tuple[str, ...]) -> str:
    """The patterns as one; those that stand at the start of a text share its ``^``, so that no other place is tried."""
    shown = [p.replace(chr(92) + "s", "[ \t\x0b\f\r\n\x85\xa0　]") for p in patterns]
    if all(p.startswith("^") and "|" not in p for p in shown):
        return f"^(?:{'|'.join(p[1:] for p in shown)})" if shown else ""
    return "|".join(f"(?:{p})" for p in shown)


def parse_blocks(docs: DataFrame, doc: str, text: str, c: Chunking = Chunking()) -> DataFrame:
    """doc, block_index (from 0), kind, text, token_count."""
    rows = docs.select(doc, F.posexplode(block_array(F.col(text), c)).alias("block_index", "_b"))
    return rows.select(doc, "block_index", "_b.kind", "_b.text", n_tokens(F.col("_b.text")).alias("token_count"))


def break_at(blocks: Column, low: float, high: float) -> Column:
    """Index of the last heading, rule or scene break whose tokens from the first block on are in [low, high]; null without one."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("int").alias("at"), F.lit(0).alias("i"))

    def step(s: Column, b: Column) -> Column:
        total = s["sum"] + b["tokens"]
        fits = b["brk"] & (total >= low) & (total <= high)
        return F.struct(total.alias("sum"), F.when(fits, s["i"]).otherwise(s["at"]).alias("at"), (s["i"] + 1).alias("i"))

    return F.aggregate(blocks, start, step, lambda s: s["at"])


def chunk_ends(blocks: Column, c: Chunking) -> Column:
    """struct<ends array<int>, extended> for an array<struct<tokens, brk>>: the last block of each chunk.

    One pass with a small state: the pile's tokens, and its latest break within the flexible part
    of the target.  What a cut leaves over holds no such break, so nothing else has to be kept.
    """
    low = c.target * (1 - c.flex)
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).cast("long").alias("cur"), F.lit(-1).alias("best"), F.lit(0).cast("long").alias("best_sum"), F.lit(0).alias("i"), F.lit(0).alias("first"))

    def once(value: Column, body) -> Column:
        """``body`` of a value that is worked out once, however often it is used."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def step(s: Column, b: Column) -> Column:
        i, tokens = s["i"], b["tokens"].cast("long")
        full = (i > s["first"]) & (s["cur"] + tokens > c.target)
        cut = F.when(s["best"] >= 0, s["best"]).otherwise(i - 1)
        cur = lambda f: F.when(~f, s["cur"] + tokens).when(s["best"] >= 0, s["cur"] - s["best_sum"] + tokens).otherwise(tokens)
        facts = once(full, lambda f: F.struct(f.alias("full"), cur(f).alias("cur")))

        def state(x: Column) -> Column:
            fits = b["brk"] & (x["cur"] >= low) & (x["cur"] <= c.target)
            return F.struct(
                F.when(x["full"], F.concat(s["ends"], F.array(cut))).otherwise(s["ends"]).alias("ends"),
                x["cur"].alias("cur"),
                F.when(fits, i).when(x["full"], -1).otherwise(s["best"]).alias("best"),
                F.when(fits, x["cur"]).when(x["full"], F.lit(0).cast("long")).otherwise(s["best_sum"]).alias("best_sum"),
                (i + 1).alias("i"),
                F.when(x["full"], cut + 1).otherwise(s["first"]).alias("first"),
            )

        return once(facts, state)

    def last(s: Column) -> Column:
        absorb = (F.size(s["ends"]) > 0) & (s["cur"] < c.least)
        kept = F.when(absorb, F.slice(s["ends"], 1, F.size(s["ends"]) - 1)).otherwise(s["ends"])
        return F.struct(F.when(s["i"] > 0, F.concat(kept, F.array(s["i"] - 1))).otherwise(kept).alias("ends"), absorb.alias("extended"))

    return F.aggregate(blocks, start, step, last)


def chunk_documents(docs: DataFrame, doc: str, text: str, c: Chunking = Chunking()) -> DataFrame:
    """A row a chunk: doc, chunk_index (from 1), block_start, block_end, token_count, extended_for_remainder, ends_at_scene_break, text."""
    blocks = F.transform(block_array(F.col(text), c), lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), n_tokens(b["text"]).alias("tokens"), b["kind"].isin("heading", "hr", "scene_break").alias("brk")))
    # blocks and cuts are columns that are used more than once, so they aren't worked out again; no filter of them, which would be
    cut = docs.select(doc, blocks.alias("_blocks")).withColumn("_cut", chunk_ends(F.col("_blocks"), c))
    ends = F.col("_cut.ends")

    def chunk(x: Column) -> Column:
        inside = x["inside"]
        return F.struct(
            (x["n"] + 1).alias("chunk_index"), x["s"].alias("block_start"), x["e"].alias("block_end"),
            # white space parts the blocks, so a chunk has its blocks' tokens
            F.aggregate(inside, F.lit(0), lambda n, b: n + b["tokens"]).alias("token_count"),
            (F.col("_cut.extended") & (x["n"] + 1 == F.size(ends))).alias("extended_for_remainder"),
            F.element_at(inside, -1)["kind"].isin("scene_break", "hr").alias("ends_at_scene_break"),
            F.array_join(F.transform(inside, lambda b: b["text"]), "\n\n").alias("text"),
        )

    spans = F.transform(ends, lambda e, n: F.struct(n.alias("n"), F.when(n == 0, 0).otherwise(F.get(ends, n - 1) + 1).alias("s"), e.alias("e")))
    pieces = F.transform(spans, lambda x: F.struct(x["n"].alias("n"), x["s"].alias("s"), x["e"].alias("e"), F.slice("_blocks", x["s"] + 1, x["e"] - x["s"] + 1).alias("inside")))
    rows = cut.select(doc, F.explode(F.transform(pieces, chunk)).alias("_c"))
    return rows.select(doc, *[f"_c.{n}" for n in ("chunk_index", "block_start", "block_end", "extended_for_remainder", "ends_at_scene_break", "text", "token_count")])


def with_chunk_ids(chunks: DataFrame, spine: str, width: int = 4) -> DataFrame:
    return chunks.withColumn("chunk_id", chunk_id(F.col(spine), F.col("chunk_index"), width))


def coverage(blocks: DataFrame, chunks: DataFrame, doc: str) -> DataFrame:
    """A row a document: blocks without a chunk, blocks in several, gaps in the chunk numbers, drift of tokens and whether all is well."""
    # one row a block, a chunk and a block of a chunk, with numbers only; a document's rows meet once, and chunks are worked out once
    number = lambda c: F.col(c).cast("long").alias(c)
    row = lambda kind, at, tokens, joins: F.struct(F.lit(kind).alias("kind"), at.cast("long").alias("at"), tokens.cast("long").alias("tokens"), joins.cast("long").alias("joins"))
    none = F.lit(None)
    told = blocks.select(doc, row("block", F.col("block_index"), F.col("token_count"), none).alias("_r"))
    inside = F.coalesce(F.transform(F.sequence(number("block_start"), number("block_end")), lambda i: row("inside", i, none, none)), F.array().cast("array<struct<kind:string,at:bigint,tokens:bigint,joins:bigint>>"))
    made = chunks.select(doc, F.explode(F.concat(F.array(row("chunk", F.col("chunk_index"), F.col("token_count"), F.col("block_end") - F.col("block_start"))), inside)).alias("_r"))
    rows = told.unionByName(made).select(doc, "_r.*").repartition(doc)
    is_ = lambda kind: F.col("kind") == kind
    at = rows.groupBy(doc, is_("chunk").alias("whole"), "at").agg(F.count_if(is_("block")).alias("n"), F.count_if(is_("block") & F.col("tokens").isNull()).alias("unknown"), F.count_if(~is_("block")).alias("times"), F.sum(F.when(is_("block"), F.col("tokens"))).alias("block_tokens"), F.sum(F.when(is_("chunk"), F.col("tokens"))).alias("chunk_tokens"), F.sum("joins").alias("joins"))
    block, chunk = ~F.col("whole"), F.col("whole")
    before = F.coalesce(F.lag("at").over(Window.partitionBy(doc, "whole").orderBy("at")), F.lit(0))
    # of chunks with one number all but the first are misnumbered
    wrong = F.when(chunk & F.col("at").isNotNull(), (F.col("at") != before + 1).cast("long") + F.col("times") - 1)
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    by = at.withColumn("wrong", wrong).groupBy(doc).agg(
        total(block & (F.col("times") == 0), F.col("n")).alias("uncovered"), total(block & (F.col("times") > 1), F.greatest("n", F.lit(1))).alias("repeated"), total(block, F.col("unknown") + (F.col("n") == 0).cast("long")).alias("unknown"),
        F.coalesce(F.sum("block_tokens"), F.lit(0)).alias("block_tokens"), F.sum("wrong").alias("misnumbered"), F.sum("chunk_tokens").alias("chunk_tokens"), total(chunk, F.col("times")).alias("n_chunks"), F.sum("joins").alias("joins"), F.count_if(block).alias("n_blocks"),
    )
    allowed = F.greatest(2 * F.col("joins") + 2 * F.col("n_chunks"), F.lit(10))
    fine = (F.col("uncovered") == 0) & (F.col("repeated") == 0) & (F.col("unknown") == 0) & (F.col("misnumbered") == 0) & (F.abs(F.col("block_tokens") - F.col("chunk_tokens")) <= allowed)
    return by.where("n_blocks > 0").select(doc, "uncovered", "repeated", "unknown", "misnumbered", "block_tokens", "chunk_tokens", fine.alias("valid"))


def eligible(docs: DataFrame, classification: str, c: Chunking = Chunking()) -> DataFrame:
    """Documents to be chunked: the listed classes, and unknown ones."""
    return docs.where(F.col(classification).isin(*c.chunkable, "unknown"))


def require_classified(docs: DataFrame, classification: str) -> DataFrame:
    """``docs``, or an error if one has no classification."""
    if docs.where(F.col(classification).isNull()).limit(1).count():
        raise ValueError("documents without a classification can't be chunked")
    return docs
