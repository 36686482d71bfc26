"""Word-shingle sets and MinHash signatures as numpy arrays (helpers used inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
#: Upper-case ASCII letters to lower case; every other byte stays.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
    dtype=np.uint64,
)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: runs without ASCII white space, A-Z lower-cased. Null and empty give none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split() if text else []


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; a shorter text is one shingle, none is empty."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE_WORDS:
        s = (h * _ODD[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)
    else:
        m = n - SHINGLE_WORDS + 1
        s = h[:m] * _ODD[0]
        for j in range(1, SHINGLE_WORDS):
            s = s + h[j : j + m] * _ODD[j]
    return np.unique(mix64(s))


def multipliers(k: int) -> np.ndarray:
    """k odd multipliers, the same in every task."""
    return mix64(np.arange(1, k + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)


def signature(u: np.ndarray, a: np.ndarray, block: int = 4096) -> np.ndarray:
    """For each multiplier the smallest product over the set, in blocks so that memory stays bounded."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(u), block):
        np.minimum(out, (u[i : i + block, None] * a[None, :]).min(axis=0), out=out)
    return out


def set_key(u: np.ndarray) -> tuple[int, int]:
    """Two order-free 64-bit sums that stand for the whole set (signed, as Spark longs)."""
    k1 = mix64(u ^ _ODD[1]).sum(dtype=np.uint64)
    k2 = mix64(u ^ _ODD[2]).sum(dtype=np.uint64)
    return int(k1.astype(np.int64)), int(k2.astype(np.int64))


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of intersection and union of two sorted distinct arrays."""
    both = np.intersect1d(a, b, assume_unique=True).size
    return both, a.size + b.size - both
