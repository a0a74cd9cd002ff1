"""Words and their hashes, for whole Arrow columns of texts at once: numpy over the UTF-8 bytes, no Python loop over words.

A word's hash is a polynomial over its bytes modulo 2^64, with random coefficients a byte, and a final mix; equal words
have equal hashes wherever they stand. Texts are taken in portions of some MB, one text at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 64, 256, np.uint64, endpoint=False) | np.uint64(1)
_BASE = np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(0xA24BAED4963EE407, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PORTION = 1 << 20
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which each bit of the input moves all of the output."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> list[np.ndarray]:
    if len(_pow[0]) < n:
        for i, x in enumerate((_BASE, _BACK)):
            a = np.full(max(n, PORTION + 1), x, np.uint64)
            a[0] = 1
            _pow[i] = np.cumprod(a)
    return _pow


def portions(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of these rows' texts within the bytes); null is empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + PORTION, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (one more at the end)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # pieces of a few MB that end with a word
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * PORTION, "right")))
        lo, hi = starts[i], ends[j - 1]
        b = data[lo:hi]
        up, back = _powers(hi - lo + 1)
        acc = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[b] if lower else b] * up[: hi - lo], out=acc[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((acc[e] - acc[s]) * back[s] + (e - s).astype(np.uint64))
        i = j
    return out


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows that don't cross texts, and the number of each one's first word."""
    if len(h) < k:
        return h[:0], np.zeros(0, np.int64)
    n = len(h) - k + 1
    w = np.zeros(n, np.uint64)
    for i in range(k):
        w = (w ^ (w >> np.uint64(29))) * _BASE + h[i : i + n]
    left = np.repeat(first[1:], np.diff(first))[:n] - np.arange(n)  # words from here to the end of the text
    ok = np.flatnonzero(left >= k)
    return mix(w[ok]), ok
