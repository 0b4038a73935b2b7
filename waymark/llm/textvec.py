"""Vectorised primitives over Arrow text columns.

A text column is handled as its UTF-8 bytes and row offsets, cut into chunks of a few MB, so memory is bounded
whatever the Arrow batch holds (one text is never cut: a text longer than a chunk is a chunk of its own).
Every function treats a null text as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_M = (1 << 64) - 1


def _splitmix_stream(seed: int, n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) + _U(seed & _M)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit value for each byte; LOWER gives A-Z the values of a-z.
BYTE_VALUE = _splitmix_stream(0x5EED, 256)
BYTE_VALUE_LOWER = BYTE_VALUE.copy()
BYTE_VALUE_LOWER[65:91] = BYTE_VALUE[97:123]

#: Byte classes. SPACE: \x20 and \x09-\x0D. ALNUM: letters, digits and all bytes of non-ASCII characters.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NONSPACE = ~SPACE
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[str, np.ndarray] = {"p": np.ones(1, dtype=_U), "i": np.ones(1, dtype=_U)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_powers["p"]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        inverse = pow(_P, -1, 1 << 64)
        for key, base in (("p", _P), ("i", inverse)):
            steps = np.full(size, base & _M, dtype=_U)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=_U)
    return _powers["p"], _powers["i"]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 row offsets of a string column."""
    column = pa.array(column) if not isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets within them) of consecutive rows of at most max_bytes, one row at least."""
    raw, offs = text_buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses a row's end."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    full = offs[:-1] < offs[1:]
    first, last = offs[:-1][full], offs[1:][full] - 1
    start[first] = mask[first]
    end[last] = mask[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each byte range, from one prefix sum of a random polynomial."""
    p, inverse = _power(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=_U)
    total[0] = 0
    np.cumsum(values[data] * p[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))


def row_bounds(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each row the index of its first range; one more entry at the end."""
    return np.searchsorted(starts, offs)


_Q = [pow(0xD1342543DE82EF95, k, 1 << 64) for k in range(1, 17)]


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their row bounds; fewer than k words, but not none, make one shingle."""
    n = len(words)
    count = np.diff(bounds)
    short = (count > 0) & (count < k)
    out_count = np.where(count >= k, count - k + 1, short.astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(out_count)])
    if n == 0:
        return np.zeros(0, _U), out_bounds
    total = np.zeros(n, dtype=_U)
    for j in range(k):
        total[: n - j] += words[j:] * _U(_Q[j])
    keep = np.zeros(n, dtype=bool)
    keep[bounds[:-1][count > 0]] = True
    row = np.repeat(np.arange(len(count)), count)
    keep |= np.arange(n) <= bounds[1:][row] - k
    for i in np.flatnonzero(short):
        part = words[bounds[i] : bounds[i + 1]]
        total[bounds[i]] = _U((sum(int(w) * _Q[j] for j, w in enumerate(part)) + len(part) * 0x2545F4914F6CDD1D) & _M)
    return mix(total[keep]), out_bounds


def sort_rows(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and their bounds."""
    parts, count = [], np.zeros(len(bounds) - 1, dtype=np.int64)
    for i in range(len(bounds) - 1):
        if bounds[i] < bounds[i + 1]:
            x = np.sort(values[bounds[i] : bounds[i + 1]])
            keep = np.ones(len(x), dtype=bool)
            keep[1:] = x[1:] != x[:-1]
            x = x[keep]
            parts.append(x)
            count[i] = len(x)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(count)])


def reduce_rows(ufunc: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """ufunc over each row's values; `empty` where it has none."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = bounds[:-1] < bounds[1:]
    if full.any():
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out
