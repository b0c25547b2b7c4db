"""Words of a text as 64-bit numbers."""

from __future__ import annotations

import numpy as np
import xxhash

MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)
# Lower case for A to Z only; other bytes stay.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Runs of bytes other than white space (0x20, 0x09 to 0x0D) of the text with A-Z in lower case."""
    return text.encode().translate(ASCII_LOWER).split() if text else []


def hashed(words: list) -> np.ndarray:
    """One 64-bit hash per word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Numbers spread over all 64 bits; equal numbers stay equal, different ones different."""
    values = values ^ (values >> SHIFT)
    values = values * MIX
    values ^= values >> SHIFT
    values *= MIX
    return values ^ (values >> SHIFT)


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) | np.uint64(1)


def shingle_set(words: list, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words are one run, no words none."""
    if not words:
        return np.empty(0, np.uint64)
    values = hashed(words)
    size = min(size, len(values))
    factors = odd_constants(size, size)
    total = values[: len(values) - size + 1] * factors[0]
    for k in range(1, size):
        total += mixed(values[k : len(values) - size + 1 + k]) * factors[k]
    return np.unique(mixed(total))
