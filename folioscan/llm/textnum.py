"""Numbers from texts, for whole Arrow batches at once.

Words are cut and hashed on the raw UTF-8 buffer of an Arrow string column
with numpy, so a task never loops over words in Python.  A word's hash is a
multilinear hash of its bytes (random 64-bit factor for each place), mixed
once more; shingles are multilinear hashes of word hashes.  Two different
words or shingles get the same 64 bits with a chance of about 2**-56.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes cut at once; working memory of a task is about 40 times this.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising steps of splitmix64, on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def factors(n: int, salt: int) -> np.ndarray:
    """n odd pseudo-random 64-bit factors that depend on salt alone."""
    at = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(at + np.uint64(salt)) | np.uint64(1)


_BYTE_FACTORS = factors(4096, 11)


def _byte_factors(n: int) -> np.ndarray:
    global _BYTE_FACTORS
    if n > len(_BYTE_FACTORS):
        _BYTE_FACTORS = factors(2 * n, 11)
    return _BYTE_FACTORS


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is an empty row."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets


def _cuts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about SLICE_BYTES that end where a row ends or before white space."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(at + SLICE_BYTES, end)
        if to < end:
            row = offsets[np.searchsorted(offsets, to, side="right") - 1]
            if row > at:
                to = int(row)
            else:
                width = SLICE_BYTES
                limit = int(offsets[np.searchsorted(offsets, at, side="right")])
                while True:
                    stop = min(to + width, limit)
                    near = np.flatnonzero(_SPACE[data[to:stop]])
                    if len(near) or stop == limit:
                        to = to + int(near[0]) if len(near) else limit
                        break
                    width *= 2
        yield at, to
        at = to


def word_hashes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, and the n + 1 offsets of rows in them."""
    data, offsets = buffers(column)
    hashes: list[np.ndarray] = []
    starts: list[np.ndarray] = []
    for a, b in _cuts(data, offsets):
        piece = data[a:b]
        if lower:
            piece = _LOWER[piece]
        inside = ~_SPACE[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        first[rows] = inside[rows]
        begin = np.flatnonzero(first)
        if not len(begin):
            continue
        keep = np.flatnonzero(inside)
        number = np.cumsum(first)[keep] - 1
        place = keep - begin[number]
        value = (piece[keep].astype(np.uint64) + np.uint64(1)) * _byte_factors(int(place.max()) + 1)[place]
        hashes.append(mix(np.add.reduceat(value, np.searchsorted(keep, begin))))
        starts.append(begin + a)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def windows(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    """Hash of each run of size words; element i is the run that starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(factors(size, salt)):
        total += words[j : j + n] * factor
    return mix(total)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``most`` bytes; a longer text comes alone."""
    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to
