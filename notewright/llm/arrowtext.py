"""Vectorised views of Arrow text columns: UTF-8 bytes, words and their hashes.

Everything here works on one Arrow batch inside a task, in groups of at most GROUP_ROWS documents
of about GROUP_BYTES together, so memory stays bounded by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP_BYTES, GROUP_ROWS = 1 << 20, 2048

#: The bytes that separate words (space, tab, line feed, vertical tab, form feed, return).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_SOLID = np.ones(256, dtype=bool)
_SOLID[list(SEPARATORS)] = False
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, dtype=np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if size > 8 * GROUP_BYTES:  # an outsize text: don't keep its table
            return table
        _powers[key] = have = table
    return have


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser over an array of 64-bit values."""
    x = x + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    ends = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def groups(offsets: np.ndarray, most: int = GROUP_BYTES, rows: int = GROUP_ROWS) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of at most `rows` documents of at most `most` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1))
        yield i, j
        i = j


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of values[start:end] for each pair; position independent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    inverse = _BASE_INVERSE if base == _BASE else np.uint64(pow(int(base), -1, 1 << 64))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power_table(base, len(values))[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * _power_table(inverse, len(values) + 1)[starts]


class Words:
    """The words of a run of documents.

    starts, ends: byte positions; hashes: 64-bit hash of each; first: n + 1 offsets, the
    words of document i are first[i] to first[i + 1].
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        self.data = data
        solid = _SOLID[data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = np.unique(offsets)
        inner = edges[(edges > 0) & (edges < len(data))]
        begins[inner] = solid[inner]
        stops[inner - 1] = solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = mix(rolling(_BYTE_CODE[data], self.starts, self.ends))

    def grams(self, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
        """Hash of the k words from each word on; valid only where they lie in one document."""
        n = max(0, len(self.hashes) - k + 1)
        at = np.arange(n)
        return mix(rolling(self.hashes, at, at + k, np.uint64(base)), 1)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i, the rightmost position of the least of values[i : i + width].

    Doubling spans, so the cost is len(values) * log2(width) whatever the data.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, span = values, np.arange(len(values), dtype=np.int32 if len(values) < 1 << 31 else np.int64), 1

    def least(a, pa_, b, pb):
        right = b <= a
        return np.where(right, b, a), np.where(right, pb, pa_)

    while span * 2 <= width:
        best, at = least(best[:-span], at[:-span], best[span:], at[span:])
        span *= 2
    shift = width - span
    if shift:
        best, at = least(best[: len(best) - shift], at[: len(at) - shift], best[shift:], at[shift:])
    return at[:n]
