"""Words and shingles of many texts at once, as 64-bit hashes.

Works on an Arrow column's own bytes: words are found and hashed for a few
megabytes of texts in one go, without a Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SLICE = 4 << 20  # bytes of text worked on at a time; a longer text is taken alone
_rng = np.random.default_rng(20240131)
_ODD = _rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A random value per byte, the same for a letter's two ASCII cases.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_tables = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(n, np.uint64(base))
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_slices(column: pa.Array, limit: int = _SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high, data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        low = high


def blanks_and(characters: str) -> np.ndarray:
    """A table of separators: the blanks and some ASCII characters."""
    marks = _BLANK.copy()
    marks[[ord(c) for c in characters]] = True
    return marks


def hashed_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _BLANK
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word; A-Z count as a-z."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begins[first] = inside[first]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return np.searchsorted(offsets, start, "right") - 1, start, end, hashes


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct k-word shingles, sorted.

    A text with fewer words has one shingle, all of it; without words, none.
    """
    row, _, _, h = hashed_words(data, offsets)
    n = len(offsets) - 1
    out = [np.zeros(0, np.uint64)] * n
    counts = np.bincount(row, minlength=n)
    first = np.concatenate(([0], np.cumsum(counts)))
    if len(h) >= k:
        joined = sum(h[j:len(h) - k + 1 + j] * _ODD[j] for j in range(k))
        joined = mix(joined)
    for i in np.flatnonzero(counts):
        a, c = first[i], counts[i]
        if c >= k:
            out[i] = np.unique(joined[a:a + c - k + 1])
        else:
            out[i] = mix((h[a:a + c] * _ODD[:c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c) * _ODD[40])
    return out
