"""Media columns: signatures are located, structures confirmed, declared types corrected, embedded media carved.

One Aho-Corasick pass over the bytes finds every magic number at once.  A hit is a candidate
only; the validator of its format walks the structure from there and returns the length that
the structure itself gives, or None.  Confirmed spans are taken from left to right, so a hit
inside a confirmed span is part of it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bounded_batches, mapped, per_document, slices, stored

# Magic numbers of the formats and their media types.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"BM": "image/bmp",
    b"\xff\xd8\xff": "image/jpeg",
    b"RIFF": "audio/wav",
    b"\x1f\x8b\x08": "application/gzip",
}
UNKNOWN = "application/octet-stream"
ROW = 192


def png_length(data: bytes, at: int) -> int | None:
    """Chunks with right checksums from IHDR to IEND."""
    pos, first = at + 8, True
    while pos + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, pos)
        end = pos + 12 + size
        if end > len(data) or first != (kind == b"IHDR") or zlib.crc32(data[pos + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return None


def gif_length(data: bytes, at: int) -> int | None:
    """Screen descriptor, colour tables, extensions and images up to the trailer."""
    try:
        flags = data[at + 10]
        pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        while True:
            kind = data[pos]
            if kind == 0x3B:
                return pos + 1 - at
            if kind == 0x21:
                pos += 2
            elif kind == 0x2C:
                flags = data[pos + 9]
                pos += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
            else:
                return None
            while size := data[pos]:
                pos += 1 + size
            pos += 1
    except IndexError:
        return None


def bmp_length(data: bytes, at: int) -> int | None:
    """The size field holds header, palette and padded rows exactly."""
    if at + 54 > len(data):
        return None
    size, zero, offset, header, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", data, at + 2)
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    fits = zero == 0 and header == 40 and planes == 1 and packing == 0 and bits in (1, 4, 8, 24, 32) and width > 0 and height
    return size if fits and offset >= 54 and size == offset + rows and at + size <= len(data) else None


def jpeg_length(data: bytes, at: int) -> int | None:
    """Segments up to the end marker; entropy-coded data is skipped to the next marker."""
    pos = at + 2
    while pos + 4 <= len(data):
        if data[pos] != 0xFF:
            return None
        kind = data[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at
        if kind == 0xFF:
            pos += 1
            continue
        pos += 2 + int.from_bytes(data[pos + 2 : pos + 4], "big")
        if kind == 0xDA:
            while (pos := data.find(b"\xff", pos)) >= 0 and pos + 1 < len(data) and (data[pos + 1] == 0 or 0xD0 <= data[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return None
    return pos + 2 - at if data[pos : pos + 2] == b"\xff\xd9" else None


def wav_length(data: bytes, at: int) -> int | None:
    """A RIFF of type WAVE whose chunks, among them fmt and data, fill its size."""
    if data[at + 8 : at + 12] != b"WAVE":
        return None
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    end, pos, kinds = at + 8 + size, at + 12, set()
    while pos + 8 <= end <= len(data):
        kinds.add(data[pos : pos + 4])
        length = int.from_bytes(data[pos + 4 : pos + 8], "little")
        pos += 8 + length + length % 2
    return size + 8 if pos == end and kinds >= {b"fmt ", b"data"} else None


def gzip_length(data: bytes, at: int) -> int | None:
    """One member that inflates to its end with the right checksum, read piece by piece."""
    inflate, pos = zlib.decompressobj(31), at
    try:
        while not inflate.eof and pos < len(data):
            inflate.decompress(data[pos : pos + 65536], 1 << 20)
            while inflate.unconsumed_tail and not inflate.eof:
                inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            pos += 65536
    except zlib.error:
        return None
    return min(pos, len(data)) - len(inflate.unused_data) - at if inflate.eof else None


VALIDATORS = {"image/png": png_length, "image/gif": gif_length, "image/bmp": bmp_length, "image/jpeg": jpeg_length, "audio/wav": wav_length, "application/gzip": gzip_length}


class Sniffer:
    """Finds confirmed media in bytes."""

    def __init__(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for magic, kind in SIGNATURES.items():
            self.machine.add_word(magic.decode("latin-1"), (len(magic), kind))
        self.machine.make_automaton()

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(type, offset, length) of each confirmed medium, not overlapping, in order."""
        found, free = [], 0
        hits = sorted((end + 1 - size, -size, kind) for end, (size, kind) in self.machine.iter(data.decode("latin-1")))
        for at, _, kind in hits:
            if at >= free and (length := VALIDATORS[kind](data, at)):
                found.append((kind, at, length))
                free = at + length
        return found

    def corrected(self, declared: str | None, spans: list[tuple[str, int, int]], size: int) -> str:
        """The type of the medium that fills the bytes from their start; without one a declared type of a known format is refused."""
        if spans and spans[0][1] == 0:
            return spans[0][0]
        return UNKNOWN if not declared or declared in VALIDATORS else declared


def png(payload: bytes) -> bytes:
    """8-bit grey rows of ROW samples."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def bmp(payload: bytes) -> bytes:
    """8-bit rows of ROW samples, the last one first, with a grey palette."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    palette = np.repeat(np.arange(256, dtype="<u4") * 0x010101, 1).astype("<u4").tobytes()
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", 1078 + len(payload), 0, 1078, 40, ROW, len(rows), 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return head + palette + rows[::-1].tobytes()


def wav(payload: bytes) -> bytes:
    """8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload


def samples(kind: str, data: bytes) -> bytes:
    """The samples that png(), bmp() or wav() stored, from the file's own structure."""
    if kind == "audio/wav":
        at = 12
        while data[at : at + 4] != b"data":
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        return data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]
    if kind == "image/bmp":
        offset, _, width, height = struct.unpack_from("<IIii", data, 10)
        return np.frombuffer(data, np.uint8, width * height, offset).reshape(height, width)[::-1].tobytes()
    if kind == "image/png":
        width = int.from_bytes(data[16:20], "big")
        at, body = 8, []
        while at < len(data):
            size, name = struct.unpack_from(">I4s", data, at)
            if name == b"IDAT":
                body.append(data[at + 8 : at + 8 + size])
            at += 12 + size
        return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()
    raise ValueError(kind)


WRITERS = (("image/png", png), ("image/bmp", bmp), ("audio/wav", wav))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, padded with spaces to a positive multiple of ROW, and their count before that."""
    data = (text or "").encode("utf-8", "replace")
    return data.ljust(max(1, -(-len(data) // ROW)) * ROW), len(data)


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, record: the payload as a medium inside a record with a header.

    Format and declared type depend on the payload alone; the declared one is wrong for about
    half of the records.  A null text counts as empty; rows, equal ones too, stay as they are.
    """

    def start():
        def one(doc_id, text):
            payload, n = payload_of(text)
            mark = zlib.crc32(payload)
            write = WRITERS[mark % 3][1]
            declared = WRITERS[(mark >> 8) % 3][0]
            return doc_id, n, declared, b"Content-Type: " + declared.encode() + b"\r\n\r\n" + write(payload)

        return one

    return per_document(docs, ["doc_id", "text"], start, "doc_id long,n_bytes long,declared string,record binary")


def carve(records: DataFrame, column: str, declared: str) -> DataFrame:
    """All rows and columns of ``records`` with ``corrected_type`` and ``media``: the confirmed media as (type, offset, length).

    Null bytes give a null type and no media; empty bytes the unknown type.  Columns of these
    names are replaced.
    """
    @F.pandas_udf("struct<corrected_type:string,media:array<struct<type:string,offset:long,length:long>>>")
    def sniff(data: pd.Series, said: pd.Series) -> pd.DataFrame:
        sniffer, rows = Sniffer(), []
        for d, s in zip(data, said):
            spans = sniffer.spans(d) if d is not None else []
            rows.append((sniffer.corrected(s, spans, len(d)) if d is not None else None, [{"type": k, "offset": a, "length": n} for k, a, n in spans]))
        return pd.DataFrame(rows, columns=["corrected_type", "media"])

    bounded_batches(records.sparkSession)
    found = sniff(F.col(column), F.col(declared))
    return records.withColumn("_found", found).withColumns({"corrected_type": F.col("_found.corrected_type"), "media": F.col("_found.media")}).drop("_found")


def features(kind: str, data: bytes) -> str:
    """Size, mean, deviation and roughness of 8-bit samples, to three places."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    n, total, square = len(x), int(x.sum()), int((x * x).sum())
    rough = int(np.abs(np.diff(x)).sum())
    return f"{kind} n={n} mean={total / n:.3f} dev={max(0.0, square / n - (total / n) ** 2) ** 0.5:.3f} rough={rough / n:.3f}"


def read_media(stored_records: DataFrame) -> DataFrame:
    """Carve the first medium of each record, read its samples and compute features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "declared_type", "corrected_type", "media_offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer, sha = Sniffer(), hashlib.sha256
        for batch in slices(batches):
            rows = []
            for doc_id, n, declared, record in zip(*(c.to_pylist() for c in batch.columns)):
                kind, at, length = sniffer.spans(record)[0]
                medium = record[at : at + length]
                data = samples(kind, medium)
                rows.append((doc_id, n, len(data), sha(data).hexdigest(), zlib.crc32(data[-16:]), length, sha(medium).hexdigest(), features(kind, data), declared, kind, at))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long,n_bytes long,payload_bytes long,payload_sha256 string,tail_crc32 long,media_bytes long,media_sha256 string,feature string,declared_type string,corrected_type string,media_offset long"
    bounded_batches(stored_records.sparkSession)
    return mapped(stored_records.select("doc_id", "n_bytes", "declared", "record"), read, schema)


def text_media(docs: DataFrame) -> DataFrame:
    """Store every text as a medium in a table, then sniff, carve and read it from there.

    An empty table gives no rows; columns besides doc_id and text are ignored.
    """
    return read_media(stored(store_texts(docs), "media"))
