"""Byte n-grams of normalised texts, computed with numpy over blocks of texts."""

from __future__ import annotations

import numpy as np

#: ASCII bytes that are no letters become spaces; bytes of other characters stay.
LETTERS = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def normal(text: str | None, least: int = 8) -> bytes:
    """Lower-cased words between single spaces, with one at either end and at least ``least`` bytes."""
    return (b" " + b" ".join((text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()) + b" ").ljust(least)


def windows(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all byte windows of the joined parts (width up to 8), and each part's first and last-plus-one window within itself."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    n = max(0, len(data) - width + 1)
    keys = np.zeros(n, np.uint64)
    for k in range(width):
        keys |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    return keys, ends - sizes, np.maximum(ends - sizes, ends - width + 1)


def slot(keys: np.ndarray, which: int, bits: int) -> np.ndarray:
    """The which-th hash of the keys, as so many bits."""
    x = (keys ^ (keys >> np.uint64(29))) * MULTIPLIERS[which]
    return ((x ^ (x >> np.uint64(32))) * MULTIPLIERS[which] >> np.uint64(64 - bits)).astype(np.int64)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values[start:end]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]
