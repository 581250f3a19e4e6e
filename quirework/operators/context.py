"""Context of a chunk: relevant entities, a rolling window of summaries, the chunk before."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from ..functions.text import n_tokens

#: Characters by which forms and texts are brought together, and characters of forms that an automaton takes (some 100 bytes each).
GRAM = 4
SCANNED = 2_000_000


def relevant_entities(chunks: DataFrame, forms: DataFrame, chunk: str, text: str, most: int = SCANNED) -> DataFrame:
    """(chunk, entity_id): entities one of whose source forms is in the chunk's text.

    Up to ``most`` characters of forms, as they are counted first, go into one automaton that passes
    each text once; more are met by blocking.  Both find the same.
    """
    listed = forms.where(F.length("source") > 0).select("entity_id", "source").distinct()
    if (listed.agg(F.sum(F.length("source"))).first()[0] or 0) <= most:
        return relevant_entities_scan(chunks, listed, chunk, text)
    return relevant_entities_blocked(chunks, listed, chunk, text)


def relevant_entities_blocked(chunks: DataFrame, forms: DataFrame, chunk: str, text: str) -> DataFrame:
    """The same for any number of forms: a form in the text has its first GRAM characters there.

    The distinct runs of GRAM characters of a text (of fewer, at its end) meet the forms that begin
    so.  A chunk's candidates are gathered and tested within the text, which is joined once.
    """
    have = chunks.where(F.length(text) > 0).select(chunk, F.col(text).alias("_text"), F.xxhash64(chunk, text).alias("_row"))
    at = F.sequence(F.lit(1), F.greatest(F.length("_text"), F.lit(1)))
    cut = lambda n: F.transform(at, lambda i: F.substring(F.col("_text"), i, F.lit(n)))
    runs = [cut(n) for n in range(1, GRAM + 1)]
    starts = have.select("_row", F.explode(F.array_distinct(F.concat(*runs))).alias("_g"))
    begun = forms.select("entity_id", "source", F.substring("source", 1, GRAM).alias("_g"))
    met = starts.distinct().join(begun, "_g").groupBy("_row").agg(F.collect_set(F.struct("source", "entity_id")).alias("_f"))
    held = have.join(met, "_row").select(chunk, F.explode(F.array_distinct(F.transform(F.filter("_f", lambda f: F.contains(F.col("_text"), f["source"])), lambda f: f["entity_id"]))).alias("entity_id"))
    return held.distinct()


def relevant_entities_scan(chunks: DataFrame, forms: DataFrame, chunk: str, text: str) -> DataFrame:
    """The same by one automaton over all forms, for forms whose size has been found small enough to be sent to all executors."""
    entity = forms.schema["entity_id"].dataType
    schema = StructType([chunks.select(chunk).schema[0], StructField("entity_id", entity)])
    by_source: dict[str, list] = {}
    for row in forms.where(F.length("source") > 0).collect():
        by_source.setdefault(row["source"], []).append(row["entity_id"])
    shared = chunks.sparkSession.sparkContext.broadcast(by_source)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for source, entities in shared.value.items():
            machine.add_word(source, entities)
        machine.make_automaton()
        kinds = to_arrow_schema(schema)
        for batch in batches:
            ids, found = [], []
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                hits = {id(es): es for _, es in machine.iter(t)}
                entities = {e for es in hits.values() for e in es}
                ids += [i] * len(entities)
                found += entities
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds.field(0).type), pa.array(found, kinds.field(1).type)], schema=kinds)

    texts = chunks.select(chunk, text).where((F.length(text) > 0) & F.lit(bool(by_source)))
    return texts.mapInArrow(scan, schema).distinct()


def rolling_window(items: DataFrame, group: str, order: str, text: str, tokens: str, budget: int = 2000) -> DataFrame:
    """For each item the texts of strictly earlier items, newest first until the budget is spent (the newest always), joined in order.

    A running sum gives each item's total so far; an earlier one is in the window if what lies from
    it up to the item fits the budget, so the range join is bounded by the budget and not by the group.
    """
    before = Window.partitionBy(group).orderBy(order)
    sums = items.withColumn("_upto", F.sum(tokens).over(before) - F.col(tokens)).withColumn("_n", F.row_number().over(before))
    step = F.lit(max(1, budget))
    a = sums.select(F.col(group), F.col(order).alias("_o"), F.col("_upto").alias("_at"), F.col("_n").alias("_i"))
    b = sums.select(F.col(group).alias("_g"), F.col(order).alias("_bo"), F.col(text).alias("_t"), F.col("_upto").alias("_from"), F.col("_n").alias("_j"))
    near = a.withColumn("_k", F.explode(F.array(F.floor(F.col("_at") / step), F.floor(F.col("_at") / step) - 1)))
    met = near.join(b.withColumn("_bk", F.floor(F.col("_from") / step)), (F.col(group) == F.col("_g")) & (F.col("_k") == F.col("_bk")) & (F.col("_j") < F.col("_i")) & (F.col("_at") - F.col("_from") <= budget))
    newest = a.join(b, (F.col(group) == F.col("_g")) & (F.col("_j") == F.col("_i") - 1))
    columns = [group, "_o", "_j", "_t"]
    window = met.select(*columns).unionByName(newest.select(*columns)).distinct().groupBy(group, "_o").agg(F.array_sort(F.collect_list(F.struct("_j", "_t"))).alias("_w"))
    out = items.join(window.withColumnRenamed("_o", order), [group, order], "left")
    return out.select(*items.columns, F.coalesce(F.size("_w"), F.lit(0)).alias("window_size"), F.coalesce(F.array_join(F.transform("_w", lambda x: x["_t"]), "\n---\n"), F.lit("")).alias("window"))


def overlap(chunks: DataFrame, book: str, spine: str, index: str, columns: list[str], across: bool = True) -> DataFrame:
    """``chunks`` with previous_<column> of the chunk before, in the document or (across) in the nearest earlier one."""
    keys = [book] if across else [book, spine]
    order = Window.partitionBy(*keys).orderBy(spine, index)
    return chunks.select("*", *[F.lag(c).over(order).alias(f"previous_{c}") for c in columns])


def ready(chunks: DataFrame, book: str, spine: str, index: str, status: str) -> DataFrame:
    """Chunks that may run: not completed, and the one before (in the book's order) is, or there is none."""
    order = Window.partitionBy(book).orderBy(spine, index)
    before = F.lag(status).over(order)
    return chunks.withColumn("_before", before).where((F.coalesce(F.col(status), F.lit("")) != "completed") & (F.col("_before").isNull() | (F.col("_before") == "completed"))).drop("_before")


def chunk_ids(documents: DataFrame, doc: str, count: str) -> DataFrame:
    """A row for each chunk number of each document."""
    return documents.where(F.col(count) > 0).select(doc, F.explode(F.sequence(F.lit(1), F.col(count))).alias("chunk_index"))


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in columns if c != order])).alias("_l")).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in columns])


def glossary_block(relevant: DataFrame, chunk: str) -> DataFrame:
    """(chunk, glossary): a chunk's entities by category, categories and entities in the order of ``ord``.

    relevant: chunk, ord, category, name, forms, summary, notes, speech_style and, where there are such,
    nicknames array<string>; speech and nicknames are shown for characters.  For a book's whole
    glossary ``chunk`` is the book.
    """
    character = F.col("category") == "character"
    about = F.coalesce(F.when(F.length("summary") > 0, F.col("summary")), F.col("notes"), F.lit(""))
    head = F.concat(F.lit("- "), F.col("name"), F.when(F.length(about) > 0, F.concat(F.lit(": "), about)).otherwise(""))
    speech = F.when(character & (F.length("speech_style") > 0), F.concat(F.lit("  speech: "), F.col("speech_style")))
    called = F.when(character & (F.size("nicknames") > 0), F.concat(F.lit("  called: "), F.array_join("nicknames", ", "))) if "nicknames" in relevant.columns else F.lit(None).cast("string")
    entry = F.concat_ws("\n", head, F.when(F.size("forms") > 0, F.concat(F.lit("  forms: "), F.array_join("forms", ", "))), speech, called)
    by = relevant.groupBy(chunk, "category").agg(F.min("ord").alias("o"), F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))).alias("l"))
    part = F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.array_join(F.transform("l", lambda x: x["e"]), "\n"))
    return by.groupBy(chunk).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("glossary"))


def too_long(glossaries: DataFrame, chunk: str, most: int = 5000) -> DataFrame:
    """(chunk, token_count) of the glossaries with more tokens than a call should be given."""
    return glossaries.select(chunk, n_tokens(F.col("glossary")).alias("token_count")).where(F.col("token_count") > most)


def glossary_text(entities: DataFrame, category: str, name: str, note: str, rank: dict[str, int]) -> DataFrame:
    """One row: entries by category in the given order (others after it, by name), alphabetical without regard to case."""
    order = F.coalesce(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col(category)], F.lit(len(rank))) if rank else F.lit(0)
    line = F.concat(F.lit("- **"), F.col(name), F.lit("**"), F.when(F.length(note) > 0, F.concat(F.lit(": "), F.col(note))).otherwise(""))
    lines = entities.groupBy(category).agg(F.first(order).alias("_r"), F.array_sort(F.collect_list(F.struct(F.lower(name).alias("k"), F.col(name).alias("n"), line.alias("l")))).alias("_e"))
    part = F.concat(F.lit("## "), F.col(category), F.lit("\n\n"), F.array_join(F.transform("_e", lambda x: x["l"]), "\n"))
    return lines.groupBy().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", category, part.alias("p")))), lambda x: x["p"]), "\n\n").alias("markdown"))
