"""Exact comparison of sets in blocks: what two similarity joins need after their filters.

Candidates are given as pairs of blocks of sets.  A task takes a pair of blocks at a time and
counts all intersections between them by matrix products over the elements that occur twice,
so no pair is ever a row; what comes out are a spanning forest of the links and each set's
number of links.  Two blocks give only the edges that connect what neither connects by itself,
so many blocks of near copies give about an edge a pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, discard, mapped, stored

#: Sets, and elements of sets, in a block, about.
BLOCK_SETS = 256
BLOCK_ELEMENTS = 300_000


def block_of(members: DataFrame, group: str, key: str, elements: str) -> DataFrame:
    """``members`` with ``block``: the sets of a group dealt by a hash into blocks of bounded size."""
    sizes = members.groupBy(group).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(elements) / BLOCK_ELEMENTS), F.lit(1)).alias("_k"))
    several = sizes.where(F.col("_k") > 1)  # few: one for each BLOCK_SETS sets at most
    part = F.pmod(F.xxhash64(key), F.coalesce("_k", F.lit(1)))
    return members.join(several, group, "left").withColumn("block", F.xxhash64(group, part)).drop("_k")


def block_pairs(placed: DataFrame, key: str) -> DataFrame:
    """Distinct pairs (p, q), p <= q, of blocks that share a key, from distinct (key, block); each block is paired with itself.

    Keys that stand in the same blocks, as those of a large group of copies do, are joined once:
    they are told by their number of blocks and 128 bits of those.
    """
    facts = placed.groupBy(key).agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("block")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "block")).alias("_y"))
    one = facts.where(F.col("_n") > 1).groupBy("_n", "_x", "_y").agg(F.min(key).alias(key)).select(key)
    some = placed.join(one, key, "left_semi")
    met = some.withColumnRenamed("block", "p").join(some.withColumnRenamed("block", "q"), key).where(F.col("p") < F.col("q")).select("p", "q").distinct()
    return met.unionByName(placed.select(F.col("block").alias("p")).distinct().withColumn("q", F.col("p")))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, as a matrix."""
    k = len(sets)
    where = np.repeat(np.arange(k), [len(s) for s in sets])
    _, term, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    rank = np.cumsum(shared) - 1
    keep = shared[term]
    where, term = where[keep], rank[term[keep]]
    out, n = np.zeros((k, k), np.float32), int(shared.sum())
    width = max(256, min(4096, (1 << 22) // max(k, 1)))
    order = np.argsort(term, kind="stable")
    where, term = where[order], term[order]
    for low in range(0, n, width):
        a, b = np.searchsorted(term, (low, low + width))
        part = np.zeros((k, min(width, n - low)), np.float32)
        part[where[a:b], term[a:b] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def forest(ids: list[int], linked: np.ndarray, parts: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph given by a matrix, each after the one that reaches its first end; sets of one part count as connected."""
    seen, edges = np.zeros(len(ids), bool), []
    for start in range(len(ids)):
        if seen[start]:
            continue
        open_ = [start] if parts is None else np.flatnonzero(parts == parts[start]).tolist()
        seen[open_] = True
        while open_:
            at = open_.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            if parts is not None:
                new = new[np.unique(parts[new], return_index=True)[1]]
            edges += [(ids[at], ids[i]) for i in new]
            new = new if parts is None else np.flatnonzero(np.isin(parts, parts[new]))
            seen[new] = True
            open_ += new.tolist()
    return edges


def parts_of(linked: np.ndarray) -> np.ndarray:
    """For each set the number of a set of its component."""
    parts = np.arange(len(linked))
    for a, b in forest(range(len(linked)), linked):
        parts[b] = parts[a]
    return parts


PACKED = "block long,ids binary,copies binary,ends binary,elements binary"


def packed(members: DataFrame, sets: DataFrame) -> DataFrame:
    """A row a block: its sets' ids, copies, ends among the elements, and elements, as 64-bit numbers.

    members: (id, block, size); sets: (id, elements).  A row has about BLOCK_ELEMENTS elements, or
    those of one set that is larger.
    """
    whole = members.join(sets, "id").select("block", "id", "size", "elements")
    dealt = whole.repartition("block").sortWithinPartitions("block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row() -> pa.RecordBatch:
            ids, copies, elements = zip(*held)
            ends = np.cumsum([len(e) // 8 for e in elements], dtype=np.int64)
            parts = [np.array(ids, np.int64).tobytes(), np.array(copies, np.int64).tobytes(), ends.tobytes(), b"".join(elements)]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], names=[f.split()[0] for f in PACKED.split(",")])

        for batch in batches:
            for block, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now and held:
                    yield row()
                    held = []
                now = block
                held.append(rest)
        if held:
            yield row()

    return mapped(dealt, run, PACKED)


def linked_in(p: tuple, q: tuple | None, percent: int) -> tuple[list, list, list]:
    """(kinds, as, bs) of a pair of blocks (ids, copies, list of sets), or of one block with itself."""
    ids, copies, sets = p if q is None else (np.concatenate([p[0], q[0]]), np.concatenate([p[1], q[1]]), p[2] + q[2])
    if len(ids) < 2:
        return [], [], []
    n = np.array([len(x) for x in sets], np.int64)
    linked = intersections(sets) * (100 + percent) >= percent * (n[:, None] + n[None, :])
    np.fill_diagonal(linked, False)
    parts = None
    if q is not None:  # only pairs across the two blocks; what is linked inside of one is found where that is paired with itself
        cut = len(p[0])
        parts = np.concatenate([parts_of(linked[:cut, :cut]), cut + parts_of(linked[cut:, cut:])])
        linked[:cut, :cut] = linked[cut:, cut:] = False
    edges = forest(ids.tolist(), linked, parts)
    counts = [(i, c) for i, c in zip(ids.tolist(), (linked @ copies).tolist()) if c]
    return [0] * len(edges) + [1] * len(counts), [e[0] for e in edges] + [c[0] for c in counts], [e[1] for e in edges] + [c[1] for c in counts]


def compare(items: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the sets of each pair of blocks, where 100 * intersection >= percent * union.

    items: distinct (p, q); members: (id, block, size), size being the copies a set stands for;
    sets: (id, elements binary of 64-bit hashes).  Returns (kind, a, b): kind 0 is a forest edge
    between ids a and b, kind 1 says that the set a has links to b copies of other sets in this
    pair of blocks.  A block is one row, so a pair of blocks is one row of the joins as well.
    """
    bounded_batches(items.sparkSession)
    whole = stored(packed(members, sets), "blocks")
    names = [f.split()[0] for f in PACKED.split(",")[1:]]
    one = lambda side: whole.select(F.col("block").alias(side), F.struct(*names).alias(f"{side}_"))
    alone = items.where(F.col("p") == F.col("q")).join(one("p"), "p").withColumn("q_", F.lit(None).cast(one("q").schema["q_"].dataType))
    pairs = items.where(F.col("p") != F.col("q")).join(one("p"), "p").join(one("q"), "q")
    rows = alone.select("p_", "q_").unionByName(pairs.select("p_", "q_"))

    def block(x: dict | None) -> tuple | None:
        if x is None:
            return None
        ids, copies, ends, elements = (np.frombuffer(x[n], kind) for n, kind in zip(names, (np.int64, np.int64, np.int64, np.uint64)))
        return ids, copies, np.split(elements, ends[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p, q = (block(c[i].as_py()) for c in batch.columns)
                found = linked_in(p, q, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int32(), pa.int64(), pa.int64()))], names=["kind", "a", "b"])

    out = stored(mapped(rows, run, "kind int,a long,b long"), "links")
    discard(whole)
    return out
