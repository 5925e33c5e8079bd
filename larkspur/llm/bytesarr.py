"""Vectorised helpers over the UTF-8 bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: One random 64-bit value for each byte, and an odd base; fixed by the seed, so every task agrees.
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the offset of each row's; a null row has none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.string()), np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, target: int = 1 << 20, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``target`` bytes and at most ``rows`` rows; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + target, side="right")) - 1
        last = min(n, first + rows, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes whose words are hashed at once.
SPAN = 1 << 19


def _powers(base: np.uint64, n: int, have: dict = {}) -> np.ndarray:  # noqa: B006  a cache
    got = have.get(int(base))
    if got is None or len(got) < n:
        got = np.ones(max(n, 1 << 16), np.uint64)
        got[1:] = base
        np.multiply.accumulate(got, out=got)
        if n <= 1 << 22:
            have[int(base)] = got
    return got[:n]


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, row of each word, words of each row) for words of anything but ASCII white space."""
    n = len(buf)
    rows = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(rows, np.int64)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~_SPACE[buf]
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    cut = np.zeros(n + 1, bool)
    cut[edge] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    hashed = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # sums of eight bytes for each byte are made for one span at a time
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + SPAN, side="right")))
        lo, hi = starts[first], ends[last - 1]
        part = buf[lo:hi]
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(BYTE_CODE[_LOWER[part] if lower else part] * _powers(BASE, hi - lo), out=total[1:])
        begin, end = starts[first:last] - lo, ends[first:last] - lo
        hashed[first:last] = mix((total[end] - total[begin]) * _powers(BASE_INVERSE, hi - lo)[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = last
    per_row = np.diff(np.searchsorted(starts, offsets))
    return hashed, np.repeat(np.arange(rows), per_row), per_row
