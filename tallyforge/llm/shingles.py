"""Sets of hashed word shingles for batches of texts, vectorised over all bytes of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: ASCII white space separates words; A to Z are lower-cased.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers for a seed."""
    start = np.uint64((seed * 0x632BE59BD9B4E019 + 1) & 0xFFFFFFFFFFFFFFFF)
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + start) | np.uint64(1)


_BYTES = seeded(256, 1)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and int64 offsets of a string column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for every text where its words start (one more for the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1][(offsets[:-1] < offsets[1:])]
    begins[at] = inside[at]
    start = np.flatnonzero(begins)
    first = np.searchsorted(start, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), first
    places = np.flatnonzero(inside)
    word = np.cumsum(begins)[places] - 1
    nth = places - start[word]
    letters = _LOWER[data[places]] if lower else data[places]
    longest = int(nth.max()) + 1
    weights = seeded(longest, 2)
    terms = _BYTES[letters] * weights[nth]
    bounds = np.searchsorted(places, start)
    length = np.diff(np.append(bounds, len(places))).astype(np.uint64)
    return mixed(np.add.reduceat(terms, bounds) + length * GOLDEN), first


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text; a text of fewer words is one shingle, without words none."""
    words, first = word_hashes(data, offsets)
    steps = seeded(width, 3)
    out: list[np.ndarray] = []
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * steps[k]
    rolled = mixed(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif n:
            whole = (words[a:b] * steps[:n]).sum(dtype=np.uint64, keepdims=True) + np.array([n], np.uint64) * GOLDEN
            out.append(mixed(whole))
        else:
            out.append(words[:0])
    return out
