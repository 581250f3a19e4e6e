"""Token-id files whose document boundaries are Elias-Fano encoded.

A data set is a Parquet table of shards.  A shard is one binary value: a header, the sorted
doc_ids and the cumulative token counts of its documents, both Elias-Fano encoded, and the ids
of its documents one after another (16 bits each where the vocabulary allows, else 32), little
endian.  n boundaries below u take about n * (2 + log2(u / n)) bits; ``select`` finds one of
them from a sample of positions and popcounts, so no table of 64-bit offsets is kept, in the
file or in memory.  Parquet is the container because executors reach every store of the
cluster through Spark's writers and readers, and through nothing else.

Documents are dealt out by quantiles of doc_id, so part files and the shards in them ascend in
doc_id; a shard knows how many ids its part holds before it, and the parts' totals (as many as
there are shuffle partitions) are summed up on reading.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import arrow_types, bounded_batches, mapped, resident, slices, workspace

MAGIC = b"EFTOK1"
HEADER = struct.Struct("<6sBBIIIQ")
SHARD_IDS = 1 << 20
SAMPLE = 256
#: Parts of a data set at most, whose quantiles and totals pass through the driver.
MAX_PARTS = 8192
MAX_WORDS = 250_000
PLAIN = re.compile(r"[!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+")
# Fixed value: how the vocabulary file splits words, for ASCII and the Latin letters of PLAIN.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u017F]+|[0-9]|[^\sa-z0-9\u00DF-\u00F6\u00F8-\u017F]+")


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTES = "".join(c for _, c in sorted(byte_letters().items()))


class EliasFano:
    """A non-decreasing sequence of integers in [0, universe]."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((int(ones[-1]) if n else 0) + 8) // 8 * 8, np.uint8)
        high[ones] = 1
        low = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        return cls(n, bits, np.packbits(low.ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<IBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, bits, a, b = struct.unpack_from("<IBII", data, at)
        at += 13
        take = lambda kind, count, at: np.frombuffer(data, kind, count, at)
        m = -(-n // SAMPLE)
        return cls(n, bits, take(np.uint8, a, at), take(np.uint8, b, at + a), take("<u4", m, at + a + b)), at + a + b + 4 * m

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sampled one bit on by popcounts of bytes, then within a byte."""
        pos, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, word = pos // 8, int(self.high[pos // 8]) >> pos % 8 << pos % 8
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        top = byte * 8 + (word & -word).bit_length() - 1 - i
        at = i * self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8].tobytes(), "little") >> at % 8
        return top << self.low_bits | chunk & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        top = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return top.astype(np.uint64)
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return (top.astype(np.uint64) << np.uint64(self.low_bits)) | (low.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)


def pack(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One shard; null doc_ids, which come first, are kept as a count."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    away = (known.astype(object) - first).astype(np.uint64) if len(known) else np.empty(0, np.uint64)
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.uint64)
    total = int(ends[-1]) if len(ends) else 0
    return b"".join((HEADER.pack(MAGIC, width, 0, len(doc_ids), nulls, total, first & (1 << 64) - 1), EliasFano.of(away, int(away[-1]) if len(away) else 0).to_bytes(), EliasFano.of(ends, total).to_bytes(), *ids))


class Shard:
    """Reader of one shard."""

    def __init__(self, data: bytes):
        magic, self.width, _, self.n, self.nulls, self.total, first = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("no token shard")
        self.first = first - (1 << 64) if first >> 63 else first
        self.docs, at = EliasFano.from_bytes(data, HEADER.size)
        self.ends, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.total, at)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.first + self.docs.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by two selects."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def rows(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the shard and ids of each document."""
        docs = [None] * self.nulls + [self.first + int(x) for x in self.docs.values()]
        start = 0
        for doc, end in zip(docs, self.ends.values().tolist()):
            yield doc, start, self.ids[start:end]
            start = end


class Words(dict):
    """Memo from a run without ASCII white space, which the tokenizer never joins to another, to its ids as bytes.

    A run of printable ASCII characters and composed Latin letters is lower-cased and cut as the
    tokenizer does it, and its pieces, of which there are fewer, are looked up; a new piece goes, as
    byte letters, to the tokenizer's model.  Other runs go to the whole tokenizer.  Both memos have two generations: what was not asked for since the last turn goes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.code = {2: "H", 4: "I"}[int(self.kind[-1])]  # native order; the files are little endian
        self.before: dict[bytes, bytes] = {}
        self.pieces = Pieces(self)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            text = word.decode()
            if PLAIN.fullmatch(text) and "<|" not in text:
                ids = b"".join(map(self.pieces.__getitem__, PIECE.findall(text.lower())))
            else:
                ids = array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(word) < 200:
            if len(self) >= MAX_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


class Pieces(dict):
    """Memo of the pieces."""

    def __init__(self, words: Words):
        self.words, self.before = words, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array(self.words.code, [t.id for t in self.words.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES))]).tobytes()
        if len(self) >= MAX_WORDS:
            self.before = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def kept_words(tokenizer: str) -> str:
    return f"token_files {tokenizer}"


def words_of(tokenizer: str) -> Words:
    """One tokenizer a Python worker, kept until the worker turns to another operator."""
    return resident(kept_words(tokenizer), lambda: Words(tokenizer))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encode every text (null: empty), append ``end_id``, write the data set to ``path`` in ascending order of doc_id.

    Rows without doc_id come first; rows of equal doc_id stay, in the order of their ids' bytes.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(1, min(MAX_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shares = [i / parts for i in range(1, parts)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("b")).first()["b"] if shares else []
    bounds = np.array(bounds or [], np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer)
        end = np.array([end_id], words.kind).tobytes()
        for batch in slices(batches):
            doc, text = batch.columns
            part = np.searchsorted(bounds, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            ids = [words.encode(t) + end for t in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part), doc, pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 if tokenizer_is_narrow(tokenizer) else 4
        names = ["part", "at", "n_ids", "n_docs", "shard"]
        part = before = held = 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def flush():
            nonlocal before, held
            row = [[part], [before], [held], [len(ids)], [pack(doc_ids, ids, width)]]
            before, held = before + held, 0
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, arrow_types(SHARD_TABLE))], names=names)

        for batch in slices(batches):
            for p, d, x in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (p != part or held >= SHARD_IDS):
                    yield flush()
                if p != part:
                    part, before = p, 0
                doc_ids.append(d)
                ids.append(x)
                held += len(x) // width
        if ids:
            yield flush()

    encoded = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), encode, "part int,doc_id long,ids binary", kept_words(tokenizer))
    dealt = encoded.repartitionById(parts, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    mapped(dealt, shards, SHARD_TABLE, kept_words(tokenizer)).write.option("compression", "zstd").parquet(path)


SHARD_TABLE = "part int,at long,n_ids long,n_docs long,shard binary"


def tokenizer_is_narrow(tokenizer: str) -> bool:
    return words_of(tokenizer).kind == "<u2"


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of 32-bit little-endian ids), from the files."""
    table = spark.read.schema(SHARD_TABLE).parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row a part, MAX_PARTS at most
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, at, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(d, base + at + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in Shard(data).rows()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    joined = table.join(F.broadcast(base), "part").select("base", "at", "shard")
    return mapped(joined, read, "doc_id long,start long,n_tokens long,ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the token files of ``docs`` into a workspace and return what reading them gives.  An empty table gives no rows."""
    path = f"{workspace(docs.sparkSession)}/tokens"
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(docs.sparkSession, path)
