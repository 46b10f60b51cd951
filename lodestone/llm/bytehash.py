"""Vectorised hashing of words and byte strings in Arrow string batches.

The hash of bytes a to b is the sum of table[byte] * BASE**position modulo 2**64, divided by BASE**a, so
one running sum over a batch gives the hash of any substring.  BASE is odd and thus invertible; the
table is random, so equal sums of different strings are as rare as for any 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}
#: Bytes of texts that are hashed together: a byte takes some 100 bytes of memory meanwhile, one longer text more.
HASHED = 1_000_000

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        size = 1 << max(16, (n - 1).bit_length())
        got = np.ones(size, np.uint64)
        got[1] = base & _MASK
        k = 2
        while k < size:
            got[k:2 * k] = got[:k] * (got[k - 1:k] * got[1:2])
            k *= 2
        _POWERS[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another (null: none), and the bounds of the texts in them."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def running(data: np.ndarray) -> np.ndarray:
    """Running sums of which differences give the hashes of substrings; see substring_hashes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(_BASE, len(data)), out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    inverse = _powers(pow(_BASE, -1, 1 << 64), len(sums))
    return (sums[b] - sums[a]) * inverse[a]


def gram_hashes(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of k bytes, in order of their starts."""
    n = len(sums) - k
    return (sums[k:] - sums[:n]) * _powers(pow(_BASE, -1, 1 << 64), n) if n > 0 else np.zeros(0, np.uint64)


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words in the texts before each text and the end."""
    inside = ~_IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles, A-Z lower-cased; with fewer
    words the hash of the whole sequence, without words none."""
    data, bounds = joined(texts)
    out, a = [], 0
    while a < len(bounds) - 1:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + HASHED, "right")) - 1)
        out += _shingle_sets(data[bounds[a]:bounds[b]], bounds[a:b + 1] - bounds[a], k)
        a = b
    return out


def _shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    data = _LOWER[data]
    starts, ends, at = word_bounds(data, bounds)
    words = mix(substring_hashes(running(data), starts, ends))
    n = max(0, len(words) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled = mix(rolled * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n])
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= k:
            s = np.sort(rolled[a:b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = mix(h * np.uint64(0xD6E8FEB86659FD93) + w)
            out.append(mix(h + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out
