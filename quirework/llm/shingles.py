"""Word shingles of whole texts as 64-bit hashes, computed with numpy over blocks of documents.

Words are the maximal runs without ASCII white space (bytes 0x20 and 0x09-0x0D) after A-Z
are lower-cased.  A word's hash is a polynomial over random 64-bit values of its bytes, a
shingle's hash mixes the hashes of its words in order.  Blocks are cut so that memory stays
near ``BLOCK_BYTES`` times a small constant, whatever the batch size; a single text longer
than that is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20

_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _upper in range(65, 91):
    _BYTE[_upper] = _BYTE[_upper + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


_POW = _powers(_BASE, 1 << 12)
_INV = _powers(_BASE_INV, 1 << 12)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words in a byte array."""
    global _POW, _INV
    n = len(data)
    if n > len(_POW):
        _POW, _INV = _powers(_BASE, n * 2), _powers(_BASE_INV, n * 2)
    word = ~_SPACE[data]
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POW[:n], out=total[1:])
    return mix((total[end] - total[start]) * _INV[start] + (end - start).astype(np.uint64)), start, end


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES each."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > begin and size + n > BLOCK_BYTES:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def shingles_at(words: np.ndarray, width: int) -> np.ndarray:
    """The shingle hash of every run of ``width`` words."""
    h = np.full(max(0, len(words) - width + 1), 0x51ED270B, np.uint64)
    for k in range(width):
        h = mix(h + words[k : k + len(h)])
    return h


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has one shingle of all of them, a text without words none."""
    for lo, hi in blocks(texts):
        part = [t or b"" for t in texts[lo:hi]]
        data = np.frombuffer(b"\n".join(part), np.uint8)
        words, start, _ = word_hashes(data)
        bounds = np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for t in part]))
        h = shingles_at(words, width)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                yield np.unique(h[a : b - width + 1])
            elif b > a:
                x = np.full(1, 0x2545F491 + int(b - a), np.uint64)
                for w in words[a:b]:
                    x = mix(x + w)
                yield x
            else:
                yield np.empty(0, np.uint64)
