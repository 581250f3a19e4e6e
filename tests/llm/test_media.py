"""Media: round trips, validators, sniffing, carving."""

import gzip
import hashlib
import random
import zlib

import pytest

from quirework.llm import media

JPEG = bytes.fromhex("ffd8ffe000104a46494600010100000100010000ffda0008010100003f00") + b"\x12\xff\x00\x34\xff\xd0\x56" + b"\xff\xd9"
GIF = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + bytes(4) + b"\1\0\1\0\0" + b"\x02\x02\x44\x01\0" + b"\x3b"
PAYLOAD = bytes(random.Random(1).randrange(256) for _ in range(192 * 3))
FILES = {"image/png": media.png(PAYLOAD), "image/bmp": media.bmp(PAYLOAD), "audio/wav": media.wav(PAYLOAD), "image/jpeg": JPEG, "image/gif": GIF, "application/gzip": gzip.compress(b"x" * 3000)}


@pytest.mark.parametrize("kind", FILES)
def test_spans(kind):
    data, s = FILES[kind], media.Sniffer()
    assert s.spans(data) == [(kind, 0, len(data))]
    assert s.spans(b"BM GIF89a RIFF junk" + data + b"tail \x1f\x8b\x08 BM") == [(kind, 19, len(data))]
    assert s.spans(data[:-1]) == [] and s.corrected("image/gif", [], 5) == media.UNKNOWN
    if kind in ("image/png", "application/gzip"):
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        assert s.spans(bytes(broken)) == []


def test_media_in_media():
    inner = media.wav(FILES["image/gif"].ljust(192))
    s = media.Sniffer()
    assert s.spans(inner) == [("audio/wav", 0, len(inner))]
    both = FILES["image/bmp"] + b"--" + FILES["image/jpeg"]
    assert [k for k, _, _ in s.spans(both)] == ["image/bmp", "image/jpeg"]


@pytest.mark.parametrize("write", media.WRITERS, ids=lambda w: w[0])
def test_samples_come_back(write):
    kind, f = write
    for n in (1, 2, 7):
        payload = bytes(random.Random(n).randrange(256) for _ in range(192 * n))
        assert media.samples(kind, f(payload)) == payload


def test_table(spark, odd, clashing, nothing):
    got = sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.text_media(clashing).collect()), key=str)
    want = []
    for r in odd.collect():
        data = (r.text or "").encode()
        padded = data + b" " * (-len(data) % 192 or (192 if not data else 0))
        want.append((r.doc_id, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert got == sorted(want, key=str)
    assert media.text_media(nothing).count() == 0


def test_carve(spark):
    rows = [(1, FILES["image/png"], "image/gif"), (2, None, "image/png"), (3, b"", "text/plain"), (4, b"hello BM", "image/bmp"), (5, b"head" + FILES["image/gif"], "text/plain")]
    df = spark.createDataFrame(rows, "id int, data binary, declared string")
    got = {r.id: (r.corrected_type, [tuple(m) for m in r.media]) for r in media.carve(df, "data", "declared").collect()}
    assert got == {1: ("image/png", [("image/png", 0, len(FILES["image/png"]))]), 2: (None, []), 3: ("text/plain", []), 4: (media.UNKNOWN, []), 5: ("text/plain", [("image/gif", 4, len(GIF))])}
