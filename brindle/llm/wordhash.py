"""Word and shingle hashes of whole Arrow columns, in blocks of bounded size, with array operations only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text that are held as arrays of 8-byte numbers at once
_rng = np.random.default_rng(20240229)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]  # A-Z hash as a-z
_VALUE[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads the bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes, one row at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, end
        at = end


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per row) for rows that ``offsets`` cuts from ``data``."""
    rows = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = ~space[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = _VALUE[data[starts[0] :]] * powers(int(lengths.max()))[place]
    counts = np.diff(np.searchsorted(starts, offsets))
    return mix(np.add.reduceat(values, starts - starts[0])), counts


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_words`; a row larger than a chunk is hashed in blocks that end at white space."""
    if len(offsets) > 2 or offsets[-1] - offsets[0] <= 4 * CHUNK:
        return _words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
    found, at, end = [], int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + CHUNK, end)
        while stop < end and not _SPACE[data[stop]]:
            stop += 1
        found.append(_words(data[at:stop], np.array([0, stop - at]))[0])
        at = stop
    hashes = np.concatenate(found)
    return hashes, np.array([len(hashes)])


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, per row the sorted distinct shingle hashes) of chunk after chunk.

    A row of fewer words than ``size`` has its whole sequence as its one shingle; one without words has none.
    """
    weights = mix(np.arange(1, size + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    data, offsets = column_bytes(column)
    for a, b in chunks(offsets):
        hashes, counts = words(data, offsets[a : b + 1])
        n = max(len(hashes) - size + 1, 0)
        joint = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            joint += hashes[k : k + n] * weights[k]
        joint = mix(joint)
        out, at = [], 0
        for count in counts.tolist():
            if count >= size:
                out.append(np.unique(joint[at : at + count - size + 1]))
            elif count:
                out.append(mix((hashes[at : at + count] * weights[:count]).sum(keepdims=True) + np.uint64(count)))
            else:
                out.append(joint[:0])
            at += count
        yield a, out
