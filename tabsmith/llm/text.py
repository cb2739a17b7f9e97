"""Vectorised text helpers for Arrow batches: byte buffers, word hashes, shingle hashes.

Everything works on whole slices of documents with numpy; no value depends on how rows are batched.
Hashes are 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: The word separators of the contracts: space, tab, newline, vertical tab, form feed, return.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words of a named stream."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) & (2**64 - 1))
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * _GOLDEN)


SPACE = np.zeros(256, bool)
SPACE[list(SEPARATORS)] = True
_PLACE = stream(2, 1024) | np.uint64(1)
_STEP = stream(3, 64) | np.uint64(1)


def _places(n: int) -> np.ndarray:
    """Odd weights of the first n byte positions of a word; no two positions share one by period."""
    return _PLACE if n <= len(_PLACE) else stream(2, n) | np.uint64(1)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def letters(seed: int) -> np.ndarray:
    """The byte values of a word hash; A-Z count as a-z."""
    out = stream(seed, 256)
    out[65:91] = out[97:123]
    return out


_LETTER = letters(1)


def words(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, letter: np.ndarray = _LETTER
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, length) of each word and the word range of each document.

    Words are runs without a separator inside one document; A-Z are hashed as a-z.
    """
    if not len(data):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = solid[heads]
    begin = np.flatnonzero(first)
    at = np.flatnonzero(solid)
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    heads_at = np.searchsorted(at, begin)
    length = np.diff(np.append(heads_at, len(at)))
    place = np.arange(len(at)) - np.repeat(heads_at, length)
    value = letter[data[at]] * _places(int(length.max()))[place]
    h = mix(np.add.reduceat(value, heads_at) + length.astype(np.uint64))
    return h, begin, length, np.searchsorted(begin, offsets)


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (runs may cross documents: slice them)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = h[:m] * _STEP[0]
    for j in range(1, n):
        total = total + h[j : j + m] * _STEP[j % 64]
    return mix(total + np.uint64(n))


def document_shingles(h: np.ndarray, bounds: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """Per document its n-word shingle hashes in order; a shorter text is one shingle, no words none."""
    runs = shingle_hashes(h, n)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            yield runs[lo : hi - n + 1]
        elif hi > lo:
            yield shingle_hashes(h[lo:hi], int(hi - lo))
        else:
            yield runs[:0]


def binary(rows: list) -> pa.Array:
    return pa.array([r if r is None or isinstance(r, bytes) else r.tobytes() for r in rows], pa.binary())


def fresh(columns: list[str], name: str) -> str:
    """A column name like ``name`` that no given column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
