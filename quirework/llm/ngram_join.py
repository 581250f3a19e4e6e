"""Similarity self-join of documents by the Jaccard index of their word n-grams, with filters under several token orders.

1. Documents with equal sets form a class; all else is done once a class.
2. Of a set of n tokens the first n - ceil(t n) + 1 under a global order are its prefix.  Sets
   that reach the threshold t share a prefix token under every order.  Here an order puts the
   corpus's frequent tokens last (by frequency) and the others by a hash; ORDERS of them use
   different hashes.  Any list of frequent tokens gives a valid order: the list only decides
   how much the filters keep, never what is found.
3. Pairs that share an infrequent prefix token under the first order and are of fitting size are
   bounded by their parity bitmaps (the Hamming distance of two bitmaps is at most the size of
   the symmetric difference), then intersected with the pairs under the other orders.
4. Sets that share a frequent prefix token, of which there may be very many, are never paired
   as rows: they go into blocks, as do the pairs left by 3, and blocks are compared exactly.
5. Components of the links are spread to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .blocks import block_of, block_pairs, compare
from .frames import bitmap_of, bounded_batches, discard, mapped, slices, stored
from .shingles import mix, shingle_sets

WIDTH = 4
PERCENT = 85
ORDERS = 2
#: Frequent tokens: at most so many (16 MB), in so many documents at least; counted where a run of so many tokens holds them so often.
HOT_TOKENS = 1 << 20
HOT_LEAST = 24
HOT_RUN = 3_000_000
HOT_IN_RUN = 2
#: Digests that a task remembers so as not to emit copies again; missing some only costs work.
REMEMBERED = 500_000


def digest(elements: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def batch_of(columns: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in columns], names=[n for n, _, _ in columns])


def frequent_in(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that occur HOT_IN_RUN times or more in the arrays, and how often; empties the list. Takes twice the arrays' bytes, and little more for the tokens that are rare."""
    tokens = np.concatenate(held)
    held.clear()
    tokens.sort()
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    last = max(0, len(tokens) - HOT_IN_RUN + 1)
    at = np.flatnonzero(first[:last] & (tokens[HOT_IN_RUN - 1 :] == tokens[:last]))
    found = tokens[at]
    return found, np.searchsorted(tokens, found, "right") - at


def survey(docs: DataFrame, sets_of: Callable) -> DataFrame:
    """A row a document (kind 0: id, digest, size) and a row for each token that is frequent in a run of tokens (kind 1: token, count)."""
    names, kinds = ["kind", "id", "d1", "d2", "n"], [pa.int32()] + [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent() -> pa.RecordBatch:
            tokens, n = frequent_in(held)
            zero = np.zeros(len(n), np.int64)
            return batch_of([(c, v, k) for c, v, k in zip(names, [zero + 1, tokens.view(np.int64), zero, zero, n], kinds)])

        for batch in slices(batches):
            rows = []
            for i, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1).to_pylist())):
                rows.append((0, i, *digest(s), len(s)))
                held.append(s)
                size += len(s)
                if size >= HOT_RUN:
                    yield frequent()
                    held, size = [], 0
            yield batch_of([(c, v, k) for c, v, k in zip(names, zip(*rows), kinds)])
        if size:
            yield frequent()

    return mapped(docs, run, "kind int,id long,d1 long,d2 long,n long")


def bitmap(elements: np.ndarray) -> bytes:
    """Parity bits of the elements' hashes; at least two bits an element, a power of two in all."""
    m = max(64, 1 << int(2 * len(elements) - 1).bit_length())
    at = (mix(elements ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(m - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=m) & 1, bitorder="little").tobytes()


def most_shared(a: bytes, b: bytes, n: int) -> int:
    """Upper bound of the intersection of two sets of n elements together: bitmaps are folded to one width."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (n - int(np.bitwise_count(x ^ y).sum())) // 2


def prefix(elements: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Infrequent prefix tokens under an order, and the frequent ones (the same under all orders)."""
    n = len(elements)
    size = n - -(-percent * n // 100) + 1
    at = np.minimum(np.searchsorted(hot, elements), max(0, len(hot) - 1))
    is_hot = hot[at] == elements if len(hot) else np.zeros(n, bool)
    cold = elements[~is_hot]
    left = max(0, size - len(cold))
    if len(cold) > size:
        cold = cold[np.argpartition(mix(cold + np.uint64(0x9E3779B97F4A7C15 * (order + 1) & (1 << 64) - 1)), size - 1)[:size]]
    return cold, elements[is_hot][np.argsort(rank[at[is_hot]], kind="stable")[:left]]


LISTS = pa.list_(pa.int64())


def index(docs: DataFrame, sets_of: Callable, order, percent: int) -> DataFrame:
    """A row for each document with a set not yet seen in its task: digest, prefix under the first order and bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = order.value
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            rows = []
            for s in sets_of(batch.column(0).to_pylist()):
                if not len(s) or (d := digest(s)) in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(d)
                cold, warm = prefix(s, hot, rank, percent, 0)
                rows.append((*d, cold.view(np.int64), warm.view(np.int64), bitmap(s)))
            if rows:
                yield batch_of([(c, list(v), k) for c, v, k in zip(["d1", "d2", "cold", "hot", "bits"], zip(*rows), [pa.int64(), pa.int64(), LISTS, LISTS, pa.binary()])])

    return mapped(docs.select("text"), run, "d1 long,d2 long,cold array<long>,hot array<long>,bits binary").dropDuplicates(["d1", "d2"])


def other_prefixes(sets: DataFrame, order, percent: int) -> DataFrame:
    """(id, n, p1, ...): infrequent prefixes under the other orders, from sets (id, elements)."""
    names, kinds = ["id", "n", *[f"p{o}" for o in range(1, ORDERS)]], [pa.int64(), pa.int64(), *[LISTS] * (ORDERS - 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = order.value
        for batch in slices(batches):
            rows = []
            for i, e in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(e, np.uint64)
                rows.append((i, len(s), *[prefix(s, hot, rank, percent, o)[0].view(np.int64) for o in range(1, ORDERS)]))
            yield batch_of([(c, list(v), k) for c, v, k in zip(names, zip(*rows), kinds)])

    return mapped(sets.select("id", "elements"), run, "id long,n long," + ",".join(f"p{o} array<long>" for o in range(1, ORDERS)))


def bounded_pairs(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, na, nb) whose bitmaps allow the threshold, as (a, b)."""
    rows = pairs.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, x, y = (c.to_pylist() for c in batch.columns)
            keep = [most_shared(x[i], y[i], na[i] + nb[i]) * (100 + percent) >= percent * (na[i] + nb[i]) for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return mapped(rows.select("a", "b", "na", "nb", "x", "y"), run, "a long,b long")


def sharing(entries: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, na, nb), a < b, of sets that share a token in ``entries`` (token, id, n) and fit in size."""
    other = entries.select("token", F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return entries.select("token", F.col("id").alias("a"), F.col("n").alias("na")).join(other, "token").where(fits).select("a", "b", "na", "nb").distinct()


def active_sets(docs: DataFrame, sets_of: Callable, active: DataFrame) -> DataFrame:
    """(id, elements) of the classes in ``active`` (id, d1, d2), from the documents' texts.

    A bitmap of digests (about 16 bits an entry, 32 MB at most) keeps the other documents
    from being shuffled; a full one only lets more of them through.
    """
    size, shared = bitmap_of(active, "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches):
            rows = []
            for s in sets_of(batch.column(0).to_pylist()):
                d = digest(s)
                at = d[0] & (size - 1)
                if len(s) and int(table[at >> 6]) >> (at & 63) & 1 and d not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(d)
                    rows.append((*d, s.tobytes()))
            if rows:
                yield batch_of([(c, v, k) for c, v, k in zip(["d1", "d2", "elements"], zip(*rows), [pa.int64(), pa.int64(), pa.binary()])])

    found = mapped(docs.select("text"), run, "d1 long,d2 long,elements binary")
    return found.join(active.select("id", "d1", "d2"), ["d1", "d2"]).select("id", "elements").dropDuplicates(["id"])


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every row of ``docs`` (doc_id, text).

    Two documents link if 100 * |intersection| >= percent * |union| of their shingle sets; equal
    sets always do.  component_id is the smallest doc_id that links reach, n_links the number of
    documents linked with this one.  A null text or one without words has no shingle and no link,
    and is its own component; a row without doc_id gets its component's smallest known doc_id, or
    null.  Repeated rows stay and count as documents.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    sets_of = lambda texts: shingle_sets(texts, width)
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    seen = stored(survey(docs, sets_of), "survey")
    rows = seen.where(F.col("kind") == 0)
    classes = rows.where(F.col("n") > 0).groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("size"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    top = seen.where(F.col("kind") == 1).groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "id").limit(HOT_TOKENS).toArrow()
    tokens, counts = top["id"].to_numpy().view(np.uint64), top["n"].to_numpy()
    by_token = np.argsort(tokens)
    order = docs.sparkSession.sparkContext.broadcast((tokens[by_token], counts[by_token]))
    entries = stored(index(docs, sets_of, order, percent).join(classes.select("d1", "d2", "id", "n"), ["d1", "d2"]).drop("d1", "d2"), "index")

    met = sharing(entries.select(F.explode("cold").alias("token"), "id", "n"), percent)
    pairs = stored(bounded_pairs(met, entries.select("id", "bits"), percent), "pairs")
    warm = entries.where(F.size("hot") > 0).select("id", "n", "hot", F.element_at("hot", 1).alias("group"))
    paired = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    concerned = stored(paired.unionByName(warm.select("id")).distinct().join(classes.select("id", "d1", "d2"), "id"), "concerned")
    sets = stored(active_sets(docs, sets_of, concerned), "sets")
    marks = other_prefixes(sets.join(paired, "id", "left_semi"), order, percent)
    near = pairs
    for o in range(1, ORDERS):
        again = sharing(marks.select(F.explode(f"p{o}").alias("token"), "id", "n"), percent).select("a", "b")
        # two sets that both reach the frequent tokens may share one of those under this order
        both = near.join(warm.select(F.col("id").alias("a")), "a", "left_semi").join(warm.select(F.col("id").alias("b")), "b", "left_semi")
        near = near.join(again.unionByName(both.select("a", "b")).distinct(), ["a", "b"], "left_semi")
    near = stored(near, "near")

    cold = near.select(F.col("a").alias("id"), "b").unionByName(near.select(F.col("b").alias("id"), F.col("a").alias("b"))).groupBy("id").agg(F.least(F.col("id"), F.min("b")).alias("group"))
    cold = cold.join(warm.select("id"), "id", "left_anti").join(classes.select("id", "n"), "id").select("id", "n", F.xxhash64("group").alias("group"))
    members = stored(block_of(warm.select("id", "n", "group").unionByName(cold), "group", "id", "n").join(classes.select("id", "size"), "id"), "members")
    place = members.select("id", "block")
    placed = warm.select("id", F.explode("hot").alias("token")).join(place, "id").select("token", "block").distinct()
    ends = near.join(place.select(F.col("id").alias("a"), F.col("block").alias("x")), "a").join(place.select(F.col("id").alias("b"), F.col("block").alias("y")), "b")
    items = stored(block_pairs(placed, "token").unionByName(ends.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))).distinct(), "items")

    found = compare(items, members.select("id", "block", "size"), sets, percent)
    discard(pairs, concerned, near, members, items, sets, entries)
    linked = components(found.where(F.col("kind") == 0).select("a", "b"))
    degree = found.where(F.col("kind") == 1).groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("links"))
    reps = linked.select(F.col("node").alias("id"), "component").join(classes.select("id", "rep"), "id")
    smallest = reps.groupBy("component").agg(F.min("rep").alias("least"))
    labels = classes.join(reps.join(smallest, "component").select("id", "least"), "id", "left").join(degree, "id", "left")
    labels = labels.select("d1", "d2", F.coalesce("least", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    shown = rows.where(F.col("n") > 0).join(labels, ["d1", "d2"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", "n_links")
    empty = rows.where(F.col("n") == 0).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return shown.unionByName(empty)
