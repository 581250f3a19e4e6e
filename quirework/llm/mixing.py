"""Mixing sources to target weights, by DataFrame functions alone.

With p the sources' token shares, the weights are p**t / sum(p**t).  t = 1 keeps the shares,
t = 0 makes the sources equal.  The exponent is found by bisection (in steps that try STEPS
exponents at once): the largest with at least the target entropy, then, if a source would be
repeated more often than allowed, the smallest above it that keeps the limit.

Weights become documents by block permutations: each source's documents fall into blocks by a
keyed hash, each epoch goes through the blocks in its own keyed order and within a block by
another.  A source takes whole epochs and, of the last one, blocks until its budget of tokens
is met; only the block that holds the cut is looked into.  So no task ever orders a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored

STEPS = 64
ROUNDS = 4
BLOCK_ROWS = 512
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_tokens(docs: DataFrame) -> DataFrame:
    """source (null is one too), docs, tokens, share of all tokens; sources without tokens have share 0."""
    by = docs.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    total = by.agg(F.sum("tokens").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("source", "docs", "tokens", "total", F.try_divide(F.col("tokens"), F.col("total")).alias("share"))  # one row of totals


def curve(shares: DataFrame, exponents: list[float], budget: float) -> list[tuple[float, float, float]]:
    """(exponent, entropy, most repetitions of a source) of each exponent, for a budget of so many times all tokens."""
    each = shares.where(F.col("share") > 0).select("share", F.explode(F.array(*[F.lit(float(t)) for t in exponents])).alias("t"))
    power = F.exp(F.col("t") * F.log("share"))
    sums = each.groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.col("t") * F.log("share")).alias("s"), F.max(power / F.col("share")).alias("m"))
    rows = sums.select("t", (F.log("z") - F.col("s") / F.col("z")).alias("h"), (F.lit(budget) * F.col("m") / F.col("z")).alias("r")).collect()
    return sorted((r["t"], r["h"], r["r"]) for r in rows)


def exponent(shares: DataFrame, entropy: float | None, repeats: float | None, budget: float) -> float:
    """The exponent in [0, 1] for a target entropy (as a part of the most that the sources allow) and a limit of repetitions."""
    ends = curve(shares, [0.0, 1.0], budget)
    if not ends:
        return 1.0
    target = (entropy or 0.0) * ends[0][1]

    def search(low: float, high: float, holds_low) -> tuple[float, float]:
        """Narrow [low, high] to where holds_low turns from true to false."""
        for _ in range(ROUNDS):
            grid = [low + (high - low) * i / STEPS for i in range(STEPS + 1)]
            good = [holds_low(h, r) for _, h, r in curve(shares, grid, budget)]
            at = max(1, good.index(False)) if False in good else STEPS
            low, high = grid[at - 1], grid[at]
        return low, high

    t = 1.0 if ends[1][1] >= target else search(0.0, 1.0, lambda h, r: h >= target)[0]
    if repeats is not None and curve(shares, [t], budget)[0][2] > repeats:
        t = 1.0 if ends[1][2] > repeats else search(t, 1.0, lambda h, r: r > repeats)[1]
    return t


def number(*parts: Column) -> Column:
    """A keyed hash as a number below 2**60, the same in every SQL that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, entropy: float | None = 0.98, repeats: float | None = 4.0, budget: float = 1.0, key: str = "mix") -> DataFrame:
    """All columns of ``docs`` (doc_id, source, text and others), each row as often as the mix takes it, with epoch and mix_order.

    ``budget`` is the mix's size as a multiple of all tokens (words of whole texts).  A source's
    copies hold its weight's part of the budget (to 1e-9), up to less than one document more.  Documents
    without words weigh nothing: they are in every whole epoch, and in the cut one with the block
    they are in.  Equal rows are placed alike.  Sorting by (epoch, mix_order) gives the mixed
    order.  A null source is a source, a null text has no words.  An empty table gives no rows;
    columns epoch and mix_order are replaced, all others stay whatever their names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "mix_order")]
    tokens = n_words("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), "doc_id", "source", tokens.alias("tokens"))
    plan = plan_mix(rows.select("doc_id", "source", "tokens"), entropy, repeats, budget, key)
    weighed = rows.select("doc", "source", row_key(F.col("doc_id"), F.col("tokens"), key).alias("row"))
    taken = plan.select(F.col("source").alias("_source"), F.col("row").alias("_row"), "copies").distinct()
    met = weighed.join(taken, weighed["source"].eqNullSafe(taken["_source"]) & (weighed["row"] == taken["_row"]))
    epochs = met.where(F.col("copies") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return epochs.select("doc.*", "epoch", number(F.lit(key), F.col("epoch"), F.col("row")).alias("mix_order"))


def row_key(doc_id: Column, tokens: Column, key: str) -> Column:
    return number(F.lit(key), F.coalesce(doc_id.cast("string"), F.lit("null")), tokens)


def plan_mix(docs: DataFrame, entropy: float | None, repeats: float | None, budget: float, key: str) -> DataFrame:
    """doc_id, source, tokens, row, block, weight, copies for every row of ``docs`` (doc_id, source, tokens)."""
    docs = stored(docs.withColumn("row", row_key(F.col("doc_id"), F.col("tokens"), key)), "tokens")
    shares = stored(source_tokens(docs), "shares")
    t = exponent(shares, entropy, repeats, budget)
    power = F.when(F.col("share") > 0, F.exp(F.lit(t) * F.log("share"))).otherwise(0.0)
    z = shares.agg(F.sum(power)).first()[0] or 1.0
    weights = shares.select("source", "tokens", (power / F.lit(z)).alias("weight"), (power / F.lit(z) * F.col("total") * budget).alias("goal"), F.ceil(F.col("docs") / BLOCK_ROWS).alias("blocks"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("goal"), F.col("tokens").cast("double")) + 1e-9), F.lit(1)).cast("long")
    weights = weights.withColumn("whole", whole).select(F.col("source").alias("_source"), "weight", "whole", "blocks", F.greatest(F.lit(0.0), F.col("goal") * (1 - 1e-9) - F.col("whole") * F.col("tokens")).alias("rest"))
    placed = docs.join(weights, docs["source"].eqNullSafe(weights["_source"])).drop("_source").withColumn("block", F.pmod("row", "blocks"))
    last = F.lit(f"{key}:last")
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy(number(last, F.col("block")), "block")  # a row a block, not a document
    before = F.sum("block_tokens").over(order) - F.col("block_tokens")
    cut = sums.withColumn("before", before).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "before", (F.col("before") < F.col("rest")).alias("begun"), (F.col("before") + F.col("block_tokens") <= F.col("rest")).alias("full"))
    joined = placed.join(cut, placed["source"].eqNullSafe(cut["_source"]) & (placed["block"] == cut["_block"])).drop("_source", "_block")
    split = F.col("begun") & ~F.col("full")
    inside = Window.partitionBy("source", "block").orderBy(number(last, F.col("row")))
    columns = ["doc_id", "source", "tokens", "row", "block", "weight"]
    partly = joined.where(split).withColumn("_upto", F.sum("tokens").over(inside)).select(*columns, (F.col("whole") + (F.col("before") + F.col("_upto") - F.col("tokens") < F.col("rest")).cast("long")).alias("copies"))
    rest = joined.where(~split).select(*columns, (F.col("whole") + (F.col("begun") & F.col("full")).cast("long")).alias("copies"))
    return partly.unionByName(rest)


def mix_table(docs: DataFrame, **target) -> DataFrame:
    """doc_id, source, n_tokens, weight, block, epoch and mix_order: one row for each time that the mix takes a document."""
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words("text").alias("tokens"))
    key = target.get("key", "mix")
    plan = plan_mix(tokens, target.get("entropy", 0.98), target.get("repeats", 4.0), target.get("budget", 1.0), key)
    epochs = plan.where(F.col("copies") > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return epochs.select("doc_id", "source", F.col("tokens").alias("n_tokens"), F.round("weight", 9).alias("weight"), "block", "epoch", number(F.lit(key), F.col("epoch"), F.col("row")).alias("mix_order"))
