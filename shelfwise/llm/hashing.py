"""Vectorised hashing of words and passages over many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1B54A32D192ED03
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLOCK = (1 << 20) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U) * U(_BASE) + U(seed)) | U(1)


def passages(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for bytes `data`, in rising order; equal bytes have equal hashes wherever they stand.
    Every eight bytes are mixed with their place in the passage before they are added up, so no rule between letters and
    places (as a polynomial has one) makes two passages equal. Works on blocks of bounded size, or of one passage where that is longer."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        block = np.append(data[base:ends[j - 1]], np.zeros(8, np.uint8))
        s, e = starts[i:j] - base, ends[i:j] - base
        count = np.maximum(1, (e - s + 7) >> 3)
        first = np.cumsum(count) - count
        place = np.arange(int(first[-1] + count[-1])) - np.repeat(first, count)
        at = np.repeat(s, count) + 8 * place
        eights = np.ndarray((len(block) - 7,), "<u8", block, strides=(1,))[at]
        inside = np.minimum(np.repeat(e, count) - at, 8).astype(U)
        eights &= np.where(inside == 8, ~U(0), (U(1) << (inside * U(8) & U(63))) - U(1))
        mixed = mix(mix(eights + U(_BASE)) + place.astype(U) * U(_STEP))
        out[i:j] = mix(np.add.reduceat(mixed, first) + (e - s).astype(U))
        i = j
    return out


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, index of each text's first word, then the number of words). Words are runs of other bytes
    than ASCII white space; A-Z count as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return passages(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of `width` words in a row; of all words where they are fewer; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(width, n)
    total = np.full(n - k + 1, k, U)
    for i, c in enumerate(constants(k, width)):
        total += mix(words[i:n - k + 1 + i] + c) * c
    return np.unique(mix(total))
