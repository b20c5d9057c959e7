"""Vectorised words and hashes of whole Arrow text columns.

The functions look at the UTF-8 bytes of many texts at once.  White space is the six ASCII
characters of ``[\\x20\\x09-\\x0D]``, which are single bytes in UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: bytes of text handled together; a single longer text is handled alone
SLICE_BYTES = 2 << 20
ODD = 0x9E3779B97F4A7C15
STEP = 0xBF58476D1CE4E5B9
M64 = (1 << 64) - 1


class Words(NamedTuple):
    """Words of several texts in order: row of the text, first byte, byte after the last, hash."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = np.bitwise_xor(x, x >> np.uint64(30))
    x *= np.uint64(STEP)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 bounds of its rows; null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if n == 0 or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(bounds, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of runs of rows with about ``most`` bytes."""
    data, at = text_bytes(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes, so all letters beyond ASCII, stay."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def spans(blank: np.ndarray, at: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each run of bytes that aren't ``blank``; runs end with their row, and at ``cuts``."""
    n = len(blank)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.ones(n + 1, bool)
    first[1:n] = blank[:-1]
    first[at[at < n]] = True
    if cuts is not None:
        first[cuts] = True
    start = np.flatnonzero(first[:n] & ~blank)
    last = first[1:]  # the next byte begins something
    last[:-1] |= blank[1:]
    last[-1] = True
    end = np.flatnonzero(last & ~blank) + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one running polynomial over all bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ODD))
    n = len(data)
    power = np.full(n, np.uint64(ODD))
    power[0] = 1
    np.cumprod(power, out=power)
    power *= values[data]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(power, out=total[1:])
    back = power  # in its place, as there may be many texts
    back[:] = np.uint64(pow(ODD, -1, 1 << 64))
    back[0] = 1
    np.cumprod(back, out=back)
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64) * np.uint64(STEP))


def words(data: np.ndarray, at: np.ndarray) -> Words:
    row, start, end = spans(space(data), at)
    return Words(row, start, end, hash_spans(data, start, end))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values (k at least 1); grams over row borders are the caller's to drop."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(ODD) + hashes[i:i + n]
    return mix(total)


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(x.view(np.int64))


def row_counts(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)
