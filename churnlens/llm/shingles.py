"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

# Odd multipliers, one for each place in a shingle (splitmix64 steps from 1).
_STEP = 0x9E3779B97F4A7C15


def _multipliers(width: int) -> list[np.uint64]:
    out, state = [], 1
    for _ in range(width):
        state = (state + _STEP) % 2**64
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) % 2**64
        out.append(np.uint64((z ^ (z >> 31)) | 1))
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (space, tab to carriage return)."""
    return text.encode().lower().split() if text else []


def shingle_set(found: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; with fewer words the whole
    sequence is one, without words there is none."""
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, found)), "<u8")
    span = min(n, width)
    total = np.full(n - span + 1, span, np.uint64)
    for k, m in enumerate(_multipliers(span)):
        total += h[k:n - span + 1 + k] * m
    out = np.sort(mixed(total))
    return out[np.append(True, out[1:] != out[:-1])]


def sets_of(texts: list[str | None], width: int = 5) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(words(text), width)
