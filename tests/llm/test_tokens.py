"""Byte-level BPE and token files against the libraries they follow."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quirework.llm import byte_bpe, token_files

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", " ", "\n", "é", "漢字", "'s", "'ll", "12", "\x1c", "\x85", "\xa0", "🎉", "--", "ing", "tion", "  ", "\t", "한국", "Привет", "\r\n", "_", "<|endoftext|>", "É", "the", "İ"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def test_encoding_and_round_trip(library):
    segments, decoder, _ = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    texts += ["a" * 5000, " " * 999 + "x", "".join(rng.choice("abcdefgh") for _ in range(20_000)), "漢" * 700, ""]
    for t in texts:
        ids = segments.encode(t)
        assert ids == library.encode_ordinary(t)
        assert decoder.decode(ids) == (t.encode(), True) and "".join(decoder.stream(ids)) == t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    segments, decoder, _ = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert decoder.decode(segments.encode(text)) == (text.encode("utf-8", "replace"), True)


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40))
def test_bytes_decode_as_they_should(data):
    _, decoder, _ = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    ranks = {v: k for k, v in decoder.bytes_of.items()}
    ids = [ranks[bytes((b,))] for b in data]
    try:
        data.decode()
        fine = True
    except UnicodeDecodeError:
        fine = False
    assert decoder.decode(ids) == (data, fine)
    for run in (1, 2, 7):
        assert "".join(decoder.stream(ids, run)) == data.decode("utf-8", "replace")
        assert b"".join(decoder.runs(ids, run)) == data


def test_reset_keeps_results(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_STATES", 40)
    monkeypatch.setattr(byte_bpe, "MAX_SEGMENTS", 5)
    segments = byte_bpe.Segments(byte_bpe.Transducer(byte_bpe.load_ranks(RANKS)), public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(200):
        t = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 14))) for _ in range(6))
        assert segments.encode(t) == library.encode_ordinary(t)


def test_bpe_table(spark, odd, clashing, nothing, library):
    rows = byte_bpe.encode_documents(clashing, RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows), key=key) == sorted(want, key=key)
    assert byte_bpe.encode_documents(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10_000), max_size=700), st.integers(0, 1 << 40))
def test_elias_fano(steps, gap):
    values = np.cumsum(np.array([s * (gap // 10_000 + 1) for s in steps], np.uint64), dtype=np.uint64)
    coded, end = token_files.EliasFano.from_bytes(b"x" + (data := token_files.EliasFano.of(values, int(values[-1]) if len(values) else 0).to_bytes()), 1)
    assert end == len(data) + 1 and coded.values().tolist() == values.tolist()
    for i in range(0, len(values), 37):
        assert coded.select(i) == int(values[i])


def test_small_space():
    ends = np.cumsum(np.random.default_rng(1).integers(0, 1000, 10_000)).astype(np.uint64)
    assert len(token_files.EliasFano.of(ends, int(ends[-1])).to_bytes()) < 10_000 * 12 / 8 + 400


def test_words_as_the_library():
    words, library = token_files.Words(WORDS), Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES + ["B", "..", "''t", "x'D", "３", "Çà", "ß", "ẞ", "×", "÷", "ŉ", "ſ", "ø", "e\u0301", "Œuf", "ĸ", "ª", "º", "µ"]) for _ in range(rng.randint(0, 20))) for _ in range(4000)]
    got = [np.frombuffer(words.encode(t), words.kind).tolist() for t in texts]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_files(spark, odd, clashing, nothing, tmp_path):
    library = Tokenizer.from_file(WORDS)
    docs = sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    want, at = [], 0
    for d, ids in docs:
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    path = f"file://{tmp_path}/tokens"
    token_files.write_token_files(clashing, path, WORDS)
    got = sorted(map(tuple, token_files.read_token_files(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    table = spark.read.parquet(path).orderBy("part", "at").collect()
    shard = token_files.Shard(bytes(table[-1].shard))
    assert shard.document(shard.n - 1).tolist() == docs[-1][1] and shard.doc_id(shard.n - 1) == 100
    assert token_files.token_files(nothing, WORDS).count() == 0
