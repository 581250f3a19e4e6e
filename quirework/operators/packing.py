"""Packing chunks of a document into batches for one call each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(tokens: Column, target: int = 8000, least: int = 1000, redistribute: float = 0.4) -> Column:
    """array<int>: the number of items in each batch of an array of token counts.

    Items go into a batch until it would exceed the target.  A last batch below ``least`` joins
    the one before; one that is below redistribute * target is evened with the one before, at the
    item boundary that makes the two most alike (the earlier one of equals).
    """
    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("sizes"), F.lit(0).cast("long").alias("cur"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("prev"))

    def step(s: Column, t: Column) -> Column:
        full = (s["n"] > 0) & (s["cur"] + t > target)
        return F.struct(F.when(full, F.concat(s["sizes"], F.array(s["n"]))).otherwise(s["sizes"]).alias("sizes"), F.when(full, t.cast("long")).otherwise(s["cur"] + t).alias("cur"), F.when(full, 1).otherwise(s["n"] + 1).alias("n"), F.when(full, s["cur"]).otherwise(s["prev"]).alias("prev"))

    def last(s: Column) -> Column:
        k = F.size(s["sizes"])
        head = F.slice(s["sizes"], 1, F.greatest(k - 1, F.lit(0)))
        two = F.element_at(s["sizes"], k) + s["n"]
        tail = F.slice(tokens, F.size(tokens) - two + 1, two)
        total = s["prev"] + s["cur"]
        left = lambda i: F.aggregate(F.slice(tail, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
        best = F.array_min(F.transform(F.sequence(F.lit(1), two - 1), lambda i: F.struct(F.abs(2 * left(i) - total).alias("d"), i.alias("i"))))["i"]
        even = F.concat(head, F.array(best, two - best))
        return F.when(s["n"] == 0, empty).when(k == 0, F.array(s["n"])).when(s["cur"] < least, F.concat(head, F.array(two))).when(s["cur"] < redistribute * target, even).otherwise(F.concat(s["sizes"], F.array(s["n"])))

    return F.aggregate(tokens, start, step, last)


def batches(items: DataFrame, doc: str, order: str, tokens: str, **how) -> DataFrame:
    """doc, batch_no (from 1), first and last item (by place in ``order``, from 1), n_items, token_count."""
    by_doc = items.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("int").alias("t")))).alias("_items"))
    counts = F.transform("_items", lambda x: x["t"])
    packed = by_doc.select(doc, counts.alias("_t"), pack(counts, **how).alias("_sizes"))
    ends = F.transform("_sizes", lambda _, i: F.aggregate(F.slice("_sizes", 1, i + 1), F.lit(0), lambda a, x: a + x))
    rows = packed.select(doc, "_t", F.posexplode(F.arrays_zip(F.col("_sizes").alias("n"), ends.alias("e"))).alias("_i", "_b"))
    inside = F.slice("_t", F.col("_b.e") - F.col("_b.n") + 1, F.col("_b.n"))
    return rows.select(doc, (F.col("_i") + 1).alias("batch_no"), (F.col("_b.e") - F.col("_b.n") + 1).alias("first_item"), F.col("_b.e").alias("last_item"), F.col("_b.n").alias("n_items"), F.aggregate(inside, F.lit(0).cast("long"), lambda a, x: a + x).alias("token_count"))


def item_id(spine: Column, batch: Column, width: int = 4) -> Column:
    return F.format_string(f"%0{width}d.b%d", spine, batch)


def batch_text(chunks: DataFrame, batch: str, chunk: str, text: str) -> DataFrame:
    """The text of each batch: its chunks in order under their ids."""
    part = F.concat(F.lit("--- chunk "), F.col(chunk), F.lit(" ---\n"), F.col(text))
    listed = F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("c"), part.alias("t"))))
    return chunks.groupBy(batch).agg(F.array_join(F.transform(listed, lambda x: x["t"]), "\n\n").alias("text"))
