"""Entity resolution: candidate pairs by blocking, evidence, tiers, winners, merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .components import components, kept

STRONG = ("source_substring", "translation_containment", "shared_reading", "alias_overlap")


def jaro_winkler(a: str, b: str) -> float:
    """The published definition, on code points: prefix of 4, weight 0.1, raised only above 0.7."""
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, matched = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == ch:
                taken[j] = True
                matched.append(ch)
                break
    m = len(matched)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(matched, (ch for ch, t in zip(b, taken) if t))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


def similarity_of(a: str | None, b: str | None) -> float:
    """0 if either is empty; else of the lower-cased, stripped strings the better of forward and reversed."""
    if not a or not b:
        return 0.0
    x, y = a.lower().strip(), b.lower().strip()
    return 1.0 if x == y else max(jaro_winkler(x, y), jaro_winkler(x[::-1], y[::-1]))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity_of(x, y) for x, y in zip(a, b)])


def ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with a < b."""
    return pairs.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def contained_pairs(forms: DataFrame, id_: str, form: str) -> DataFrame:
    """(inner, outer, form): forms of two characters or more that another entity's form contains.

    Lossless blocking: the containing form has the first two characters of the contained one at
    some place, so all bigrams of one side meet the first bigram of the other.
    """
    f = forms.select(F.col(id_).alias("id"), F.col(form).alias("f")).where(F.length("f") > 1).distinct()
    inner = f.select(F.col("id").alias("inner"), F.col("f").alias("x"), F.substring("f", 1, 2).alias("g"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("f") - 1), lambda i: F.substring(F.col("f"), i, F.lit(2))))
    outer = f.select(F.col("id").alias("outer"), F.col("f").alias("y"), F.explode(grams).alias("g"))
    return inner.join(outer, "g").where((F.col("inner") != F.col("outer")) & F.col("y").contains(F.col("x"))).select("inner", "outer", F.col("x").alias("form")).distinct()


def substring_pairs(forms: DataFrame, id_: str, form: str) -> DataFrame:
    return ordered(contained_pairs(forms, id_, form).select(F.col("inner").alias("a"), F.col("outer").alias("b")))


def shared_value_pairs(values: DataFrame, id_: str, value: str) -> DataFrame:
    """Entities that share a value that is not null."""
    v = values.where(F.col(value).isNotNull()).select(F.col(id_).alias("id"), F.col(value).alias("v")).distinct()
    return v.select(F.col("id").alias("a"), "v").join(v.select(F.col("id").alias("b"), "v"), "v").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def shared_value_edges(values: DataFrame, id_: str, value: str) -> DataFrame:
    """Edges (a, b) from the smallest entity of each shared value to the others: the same components as all pairs, in one row an entity and value."""
    v = values.where(F.col(value).isNotNull()).select(F.col(id_).alias("b"), F.col(value).alias("v")).distinct()
    least = v.groupBy("v").agg(F.min("b").alias("a"), F.count("*").alias("n")).where(F.col("n") > 1).select("v", "a")
    return v.join(least, "v").where(F.col("a") < F.col("b")).select("a", "b").distinct()


def alias_pairs(aliases: DataFrame, sources: DataFrame, id_: str, value: str) -> DataFrame:
    """Entities one of whose aliases is the other's source or alias."""
    a = aliases.select(F.col(id_).alias("a"), F.col(value).alias("v")).distinct()
    every = sources.select(F.col(id_).alias("b"), F.col(value).alias("v")).unionByName(aliases.select(F.col(id_).alias("b"), F.col(value).alias("v"))).distinct()
    return ordered(a.join(every, "v"))


def fuzzy_pairs(forms: DataFrame, id_: str, form: str, threshold: float = 0.75) -> DataFrame:
    """(a, b, jw): best similarity of any two forms of two entities, at or above the threshold.

    Only distinct forms are compared.  A similarity above 0.7 needs a common character and lengths
    that can reach it: at most (2 + short / long) / 3 before the prefix is counted, so pairs of
    forms that share no character or differ too much in length never meet the comparison.
    """
    f = forms.select(F.col(id_).alias("id"), F.lower(F.trim(F.col(form))).alias("f")).where(F.length("f") > 0).distinct()
    words = kept(f.select("f").distinct())
    chars = words.select("f", F.explode(F.array_distinct(F.split("f", ""))).alias("c")).where(F.length("c") > 0)
    x, y = chars.select(F.col("f").alias("x"), "c"), chars.select(F.col("f").alias("y"), "c")
    ratio = F.least(F.length("x"), F.length("y")) / F.greatest(F.length("x"), F.length("y"))
    jaro = (2 + ratio) / 3
    near = x.join(y, "c").where((F.col("x") < F.col("y")) & (jaro + 0.4 * (1 - jaro) >= threshold)).select("x", "y").distinct()
    scored = near.withColumn("jw", similarity("x", "y")).where(F.col("jw") >= threshold)
    both = scored.unionByName(words.select(F.col("f").alias("x"), F.col("f").alias("y"), F.lit(1.0).alias("jw")))
    i, j = f.select(F.col("id").alias("i"), F.col("f").alias("x")), f.select(F.col("id").alias("j"), F.col("f").alias("y"))
    met = both.join(i, "x").join(j, "y").where(F.col("i") != F.col("j"))
    return met.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(F.max("jw").alias("jw"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors as doubles; null if one has length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Bytes of the vectors that a task holds, and rows on each side of a product.
HELD_BYTES = 32 << 20
TILE = 1024


def n_blocks(rows: int, wide: int, blocks: int = 8) -> int:
    """Blocks of vectors: few for few rows, and so many that each stays within about HELD_BYTES."""
    return max(1, min(blocks, -(-rows // TILE)), -(-rows * max(wide, 1) * 8 // HELD_BYTES))


def cosine_pairs(vectors: DataFrame, id_: str, vector: str, threshold: float = 0.55, blocks: int = 8) -> DataFrame:
    """(a, b, cosine) of all pairs at or above the threshold, by products of blocks of the matrix.

    Each pair of blocks is a task of its own.  It holds the vectors of one block, HELD_BYTES of them,
    and multiplies them by the other's as they arrive, TILE rows by TILE rows; so its memory
    doesn't depend on the table, and only the number of tasks grows with the number of pairs.
    """
    element = vectors.schema[vector].dataType.elementType.simpleString()
    plain = F.col(vector) if element in ("float", "double") else F.col(vector).cast("array<double>")
    v = vectors.select(F.col(id_).alias("id"), plain.alias("v")).where(F.col("v").isNotNull() & F.col("id").isNotNull())
    rows, wide = v.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n = n_blocks(rows, wide, blocks)
    block = v.withColumn("k", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # a row goes to the pairs of its block: to be held (side 0) in those where the block comes first, to pass by (side 1) where it comes last
    mine = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(F.least(i, F.col("k")).alias("p"), F.greatest(i, F.col("k")).alias("q"), (i < F.col("k")).cast("int").alias("side")))
    dealt = block.select("id", "v", F.explode(F.concat(mine, F.array(F.struct(F.col("k").alias("p"), F.col("k").alias("q"), F.lit(1).alias("side"))))).alias("_o")).select("id", "v", "_o.*")
    place = (F.col("q") * (F.col("q") + 1) / 2).cast("int") + F.col("p")
    placed = dealt.repartitionById(n * (n + 1) // 2, place).sortWithinPartitions("p", "q", "side").select("id", "v", "p", "q", "side")
    kind = v.schema["id"].dataType.simpleString()
    return placed.mapInArrow(lambda batches: block_products(batches, threshold), f"a {kind}, b {kind}, cosine double")


def block_products(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) from pairs of blocks (id, v, p, q, side), one after another, the rows to be held first."""
    pair, held = None, []
    for batch in batches:
        head = np.stack([batch.column(i).to_numpy() for i in (2, 3, 4)])
        turns = np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *turns], [*turns, batch.num_rows]):
            for at in range(start, end, TILE):
                p, q, side = head[:, at].tolist()
                if pair != (p, q):
                    pair, held = (p, q), []
                ids, x = unit_vectors(batch.slice(at, min(TILE, end - at)))
                if side == 0:
                    held.append((ids, x))
                for others, y in held if side else ():
                    yield close(others, y, ids, x, p == q, threshold, batch.schema.field(0).type)


def unit_vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Copies of a batch's ids and, as doubles of length one, of its vectors."""
    v = batch.column(1)
    if len(set(v.value_lengths().unique().to_pylist())) > 1:
        raise ValueError("vectors of different lengths")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return batch.column(0).to_numpy(zero_copy_only=False).copy(), x


def close(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, same: bool, threshold: float, kind: pa.DataType) -> pa.RecordBatch:
    """The pairs of two tiles at or above the threshold; of one block's with itself, each once."""
    c = x @ y.T
    i, j = np.nonzero(c >= threshold - 1e-12)
    a, b = ids[i], others[j]
    keep = np.flatnonzero(a < b if same else a != b)
    a, b = a[keep], b[keep]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), kind), pa.array(np.maximum(a, b), kind), pa.array(c[i[keep], j[keep]])], ["a", "b", "cosine"])


def evidence(tagged: dict[str, DataFrame], categories: DataFrame | None = None) -> DataFrame:
    """(a, b, heuristics, jw, cosine, same_category) from the pairs of each heuristic; jw and cosine as far as they are known."""
    parts = []
    for name, pairs in tagged.items():
        score = {c: F.col(c) if c in pairs.columns else F.lit(None).cast("double") for c in ("jw", "cosine")}
        parts.append(pairs.select("a", "b", F.lit(name).alias("h"), *[v.alias(c) for c, v in score.items()]))
    every = reduce(DataFrame.unionByName, parts).where(F.col("a") < F.col("b"))
    out = every.groupBy("a", "b").agg(F.array_sort(F.collect_set("h")).alias("heuristics"), F.max("jw").alias("jw"), F.max("cosine").alias("cosine"))
    if categories is None:
        return out
    c = categories.select("id", "category")
    both = out.join(c.select(F.col("id").alias("a"), F.col("category").alias("ca")), "a", "left").join(c.select(F.col("id").alias("b"), F.col("category").alias("cb")), "b", "left")
    return both.withColumn("same_category", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).drop("ca", "cb")


def tier(embeddings: bool = False, jw_strong: float = 0.90, auto: float = 0.82, low: float = 0.50) -> Column:
    """HIGH, MEDIUM or LOW from heuristics, jw, cosine and same_category.

    Each strong heuristic and a jw of jw_strong count one; two and one category make HIGH.  With
    embeddings a cosine of ``auto`` counts one too and HIGH needs it; a pair that only the
    embedding found is LOW below ``low``.
    """
    strong = F.size(F.array_intersect("heuristics", F.array(*[F.lit(s) for s in STRONG]))) + F.coalesce(F.col("jw") >= jw_strong, F.lit(False)).cast("int")
    if not embeddings:
        return F.when((strong >= 2) & F.col("same_category"), "HIGH").otherwise("MEDIUM")
    close = F.coalesce(F.col("cosine") >= auto, F.lit(False))
    alone = (F.size("heuristics") == 1) & F.array_contains("heuristics", "embedding") & (F.coalesce(F.col("cosine"), F.lit(0.0)) < low)
    return F.when(alone, "LOW").when((strong + close.cast("int") >= 2) & close & F.col("same_category"), "HIGH").otherwise("MEDIUM")


def direction(a_in_b: Column, b_in_a: Column) -> Column:
    """Which one contains the other ('a' or 'b'); null if none or both do."""
    return F.when(a_in_b & ~b_in_a, "b").when(b_in_a & ~a_in_b, "a")


def winner(translation_contains: Column, source_contains: Column, name_a: Column, name_b: Column, seen_a: Column, seen_b: Column) -> Column:
    """'a' or 'b': the containing one, by translation before source; else the longer name; else the one seen first; else a."""
    contains = F.coalesce(translation_contains, source_contains)
    longer = F.when(F.length(name_a) > F.length(name_b), "a").when(F.length(name_b) > F.length(name_a), "b")
    return F.coalesce(contains, longer, F.when(seen_a <= seen_b, "a").otherwise("b"))


def winners(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``pairs`` (a, b and, where known, container: 'a' or 'b') with survivor and absorbed, by ``winner`` of their entities (id, name, first_seen)."""
    one = lambda c: entities.select(F.col("id").alias(c), F.col("name").alias(f"_n{c}"), F.col("first_seen").alias(f"_s{c}"))
    container = F.col("container") if "container" in pairs.columns else F.lit(None).cast("string")
    both = pairs.join(one("a"), "a").join(one("b"), "b")
    unknown = F.col("_sa").isNull() | F.col("_sb").isNull()  # then the first one wins a tie
    seen = lambda c: F.when(unknown, F.col("_sa")).otherwise(F.col(c))
    first = winner(container, F.lit(None).cast("string"), F.coalesce("_na", F.lit("")), F.coalesce("_nb", F.lit("")), seen("_sa"), seen("_sb"))
    out = both.withColumn("_w", F.when(unknown & container.isNull() & (F.length("_na") == F.length("_nb")), "a").otherwise(first))
    return out.select(*pairs.columns, F.when(F.col("_w") == "a", F.col("a")).otherwise(F.col("b")).alias("survivor"), F.when(F.col("_w") == "a", F.col("b")).otherwise(F.col("a")).alias("absorbed"))


def survivors(remap: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, component) with each component named by its survivor: of its members the one that won most and lost least, then the smallest.

    remap: node, component; pairs: survivor, absorbed.
    """
    points = pairs.select(F.col("survivor").alias("node"), F.lit(1).alias("p")).unionByName(pairs.select(F.col("absorbed").alias("node"), F.lit(-1).alias("p"))).groupBy("node").agg(F.sum("p").alias("p"))
    ranked = remap.join(points, "node", "left").withColumn("p", F.coalesce("p", F.lit(0)))
    top = ranked.groupBy("component").agg(F.min(F.struct((-F.col("p")).alias("p"), "node")).alias("t")).select("component", F.col("t.node").alias("survivor"))
    return remap.join(top, "component").select("node", F.col("survivor").alias("component"))


def merged(entities: DataFrame, remap: DataFrame) -> DataFrame:
    """Entities folded by their survivor (remap: node, component), in the order of ``ord``.

    entities: id, ord, name, forms array<string>, aliases array<string>, notes, first_seen, last_seen
    and, where there are such, summary, speech_style, books array<string>, nicknames
    array<struct<speaker, nick>>.  The survivor's name and first entries come first; lists keep the
    order of first appearance, a speaker's first nickname counts.
    """
    extra = [c for c in ("summary", "speech_style", "books", "nicknames") if c in entities.columns]
    rows = entities.join(remap.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("root", F.coalesce("component", "id"))
    key = F.struct((F.col("id") != F.col("root")).alias("absorbed"), "ord", "name", "forms", "aliases", "notes", *extra)
    folded = rows.groupBy("root").agg(F.array_sort(F.collect_list(key)).alias("l"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count("*").alias("n_merged"))
    each = lambda c: F.transform("l", lambda x: x[c])
    lists = lambda c: F.array_distinct(F.flatten(F.filter(each(c), lambda x: x.isNotNull())))
    joined = lambda c: F.aggregate(F.filter(each(c), lambda n: F.length(n) > 0), F.lit(""), lambda s, n: F.when(s.contains(n), s).when(s == "", n).otherwise(F.concat(s, F.lit(" "), n)))
    more = {
        "summary": lambda: summary_fold(each("summary"), SUMMARY),
        "speech_style": lambda: F.array_join(F.array_distinct(F.flatten(F.transform(F.filter(each("speech_style"), lambda x: F.length(x) > 0), lambda x: F.split(x, STYLES)))), STYLES),
        "books": lambda: lists("books"),
        "nicknames": lambda: F.aggregate(lists("nicknames"), F.array().cast(entities.schema["nicknames"].dataType), lambda s, x: F.when(F.exists(s, lambda y: y["speaker"] == x["speaker"]), s).otherwise(F.concat(s, F.array(x)))),
    }
    return folded.select(F.col("root").alias("id"), F.get("l", F.lit(0))["name"].alias("name"), lists("forms").alias("forms"), lists("aliases").alias("aliases"), joined("notes").alias("notes"), "first_seen", "last_seen", "n_merged", *[more[c]().alias(c) for c in extra])


SUMMARY = 500
#: Between observations of how a character speaks.
STYLES = "\n"


def summary_fold(observations: Column, limit: int = SUMMARY) -> Column:
    """An ordered array of summaries as one: what is in it already is skipped; else appended, and cut at a space with three dots."""

    def step(s: Column, x: Column) -> Column:
        both = F.when(F.length(s) == 0, x).otherwise(F.concat(s, F.lit(" "), x))
        cut = F.when(F.length(both) > limit, F.concat(F.regexp_replace(F.substring(both, 1, limit), " [^ ]*$", ""), F.lit("..."))).otherwise(both)
        return F.when(s.contains(x) | (F.length(x) == 0), s).otherwise(cut)

    return F.aggregate(F.filter(observations, lambda x: x.isNotNull()), F.lit(""), step)


def merged_forms(forms: DataFrame, remap: DataFrame) -> DataFrame:
    """Surface forms (entity_id, source, translation, translation_variants, reading, occurrence_count, first_seen_chunk) by survivor.

    Of forms with one source the survivor's stays, then the smallest entity's; counts add up, the
    first reading that is not empty counts, other translations become variants.
    """
    rows = forms.join(remap.select(F.col("node").alias("entity_id"), "component"), "entity_id", "left").withColumn("root", F.coalesce("component", "entity_id"))
    key = F.struct((F.col("entity_id") != F.col("root")).alias("absorbed"), "entity_id", "translation", "translation_variants", "reading")
    by = rows.groupBy("root", "source").agg(F.array_sort(F.collect_list(key)).alias("l"), F.sum("occurrence_count").alias("occurrence_count"), F.min("first_seen_chunk").alias("first_seen_chunk"))
    told = F.get("l", F.lit(0))["translation"]
    variants = F.filter(F.array_distinct(F.flatten(F.transform("l", lambda x: F.concat(F.array(x["translation"]), F.coalesce(x["translation_variants"], F.array().cast("array<string>")))))), lambda t: t.isNotNull() & ~t.eqNullSafe(told))
    reading = F.get(F.filter(F.transform("l", lambda x: x["reading"]), lambda r: F.length(r) > 0), F.lit(0))
    return by.select(F.col("root").alias("entity_id"), "source", told.alias("translation"), variants.alias("translation_variants"), reading.alias("reading"), "occurrence_count", "first_seen_chunk")


def remapped(pairs: DataFrame, remap: DataFrame) -> DataFrame:
    """Pairs between survivors; pairs that have become one entity go."""
    ends = [remap.select(F.col("node").alias(c), F.col("component").alias(f"r{c}")) for c in "ab"]
    a = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
    return ordered(a.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))


def embedding_text(category: Column, name: Column, sources: Column, translations: Column, summary: Column, hints: Column) -> Column:
    """What an entity's vector is made from: its parts that are not empty, parted by '. '."""
    join = lambda c: F.array_join(F.filter(c, lambda x: F.length(x) > 0), ", ")
    parts = F.array(category, name, join(sources), join(translations), summary, join(hints))
    return F.array_join(F.filter(parts, lambda x: F.length(x) > 0), ". ")


def remapped_conflicts(conflicts: DataFrame, remap: DataFrame) -> DataFrame:
    """Conflicts (entity_id, current_translation, alternatives) by survivor: its own translation stays, the others' are alternatives."""
    m = remap.select(F.col("node").alias("entity_id"), "component")
    rows = conflicts.join(m, "entity_id", "left").withColumn("root", F.coalesce("component", "entity_id"))
    l = F.array_sort(F.collect_list(F.struct((F.col("entity_id") != F.col("root")).alias("absorbed"), "entity_id", "current_translation", "alternatives")))  # noqa: E741
    by = rows.groupBy("root").agg(l.alias("l"))
    current = F.get("l", F.lit(0))["current_translation"]
    every = F.array_distinct(F.flatten(F.transform("l", lambda x: F.concat(F.array(x["current_translation"]), x["alternatives"]))))
    return by.select(F.col("root").alias("entity_id"), current.alias("current_translation"), F.filter(every, lambda x: x != current).alias("alternatives"))


def prompt_text(name: Column, category: Column, forms: Column, aliases: Column, summary: Column) -> Column:
    """An entity as shown to a judge of pairs."""
    line = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(f"{label}: "), c))
    return F.concat_ws("\n", F.concat(name, F.lit(" ("), category, F.lit(")")), line("forms", F.array_join(forms, ", ")), line("aliases", F.array_join(aliases, ", ")), line("summary", summary))


def decided(decisions: DataFrame, remap: DataFrame) -> DataFrame:
    """Decisions (a, b, same_entity, preferred) between survivors: pairs to merge and the one that is to survive (a if the preferred one is neither)."""
    m = remap.select("node", "component")
    rows = decisions.where("same_entity").join(m.select(F.col("node").alias("a"), F.col("component").alias("ra")), "a", "left").join(m.select(F.col("node").alias("b"), F.col("component").alias("rb")), "b", "left")
    x, y = F.coalesce("ra", "a"), F.coalesce("rb", "b")
    kept_one = F.when(F.col("preferred") == F.col("b"), y).otherwise(x)
    return rows.select(x.alias("a"), y.alias("b"), kept_one.alias("survivor")).where(F.col("a") != F.col("b")).distinct()


def report(rounds: DataFrame) -> DataFrame:
    """One row: a report of merges.  rounds: round, tier, n_pairs, n_merged."""
    head = F.lit("| round | tier | pairs | merged |\n| --- | --- | --- | --- |\n")
    line = F.format_string("| %d | %s | %d | %d |", "round", "tier", "n_pairs", "n_merged")
    listed = F.array_sort(F.collect_list(F.struct("round", "tier", line.alias("l"))))
    return rounds.groupBy().agg(F.concat(head, F.array_join(F.transform(listed, lambda x: x["l"]), "\n")).alias("markdown"))


def resolve(entities: DataFrame, candidates: Callable[[DataFrame], DataFrame], judge: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 3, embeddings: bool = False) -> tuple[DataFrame, DataFrame]:
    """Merge until nothing changes, at most ``rounds`` times: (entities, remap).

    ``candidates`` makes evidence from entities (and may say which side contains the other: container);
    HIGH pairs merge, MEDIUM ones go to ``judge`` (a function that keeps the pairs which are one
    entity, and may name the one to survive: preferred), LOW ones are dropped.  Membership is the
    components of the accepted pairs; a component is named by the member that wins its pairs.
    """
    spark = entities.sparkSession
    id_ = entities.schema["id"].dataType.simpleString()
    total = spark.createDataFrame([], f"node {id_}, component {id_}")
    plain = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    for _ in range(rounds):
        found = kept(candidates(entities).withColumn("tier", tier(embeddings)))
        high = found.where(F.col("tier") == "HIGH")
        accepted = winners(high.select("a", "b", plain(high, "container").alias("container")), entities).select("a", "b", "survivor", "absorbed")
        if judge is not None:
            yes = judge(found.where(F.col("tier") == "MEDIUM"))
            choice = F.when(plain(yes, "preferred").cast(id_) == F.col("b"), "b").otherwise("a")
            accepted = accepted.unionByName(winners(yes.select("a", "b", choice.alias("container")), entities).select("a", "b", "survivor", "absorbed"))
        accepted = kept(accepted)
        if accepted.limit(1).count() == 0:
            break
        step = kept(survivors(components(accepted.select("a", "b")), accepted))
        entities = kept(merged(entities, step).withColumn("ord", F.col("first_seen")))
        old = total.join(step.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        total = kept(old.unionByName(step.join(old.select("node"), "node", "left_anti")))
    return entities, total
