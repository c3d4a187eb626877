"""Words of many texts as 64-bit hashes, computed in whole Arrow batches.

A word is a run of bytes other than 0x20 and 0x09-0x0D; those are ASCII, so the
bytes of UTF-8 can be cut without decoding. The hash of a word is a polynomial
over its bytes modulo 2^64, taken from one running sum over the batch, then
scrambled together with the word's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 3
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_ODD = np.random.default_rng(20240807).integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CHUNK_BYTES = 1 << 20

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i < n, kept for the next batch."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        _powers[:] = []
        for base in (_BASE, _BASE_INVERSE):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _powers.append(np.cumprod(factors, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``data``: bytes of texts one after the other, cut at ``bounds`` (n + 1 places).
    Returns the words' hashes and n + 1 bounds of each text's words."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, dtype=bool)
    first[bounds] = True
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1] | first[1:n]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    power, inverse = _power_tables(n)
    weighted = data.astype(np.uint64)
    weighted += np.uint64(1)
    weighted *= power
    running = np.cumsum(weighted, dtype=np.uint64)
    hashes = (running[ends] - running[starts] + weighted[starts]) * inverse[starts]
    hashes += (ends - starts + 1).astype(np.uint64) * _ODD[15]
    return mix(hashes), np.searchsorted(starts, bounds)


def ngrams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` (up to 15) consecutive words, over text borders too."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    total = words[:len(words) - n + 1] * _ODD[0] + np.uint64(salt + n)
    for k in range(1, n):
        total += words[k:len(words) - n + 1 + k] * _ODD[k]
    return mix(total)


def text_chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of successive rows with about ``chunk_bytes``
    of text each; a longer text comes alone. A null text counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + chunk_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end
