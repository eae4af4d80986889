"""Vectorised text kernels over Arrow string columns: byte blocks, word hashes, shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: White space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Lower-cases A-Z, leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240607)
#: Of white space zero, so that it adds nothing to the word before it.
_LETTER = np.where(SPACE, np.uint64(0), _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    table = np.full(n, base, np.uint64)
    table[:1] = 1
    return np.multiply.accumulate(table)


_BASE, _SHINGLE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: For words of usual lengths; longer ones get tables of their own, which are not kept.
_SHORT = _powers(_BASE, 256)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def byte_blocks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about `most` bytes; a longer text is a block of its own. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        j = min(j, len(column))
        yield i, buf[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def word_bounds(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words, in order; no word crosses rows."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    np.logical_not(space[buf], out=inside[:n])
    start = inside[:n].copy()
    start[1:] &= ~inside[: n - 1] if n else start[1:]
    end = inside[:n] & ~inside[1 : n + 1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words after lower-casing A-Z, and each row's first word number (rows + 1 entries)."""
    starts, ends = word_bounds(buf, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.searchsorted(starts, offsets)
    sizes = ends - starts
    longest = int(sizes.max())
    factors = _SHORT if longest <= len(_SHORT) else _powers(_BASE, longest)
    place = np.arange(starts[0], len(buf)) - np.repeat(starts, np.diff(np.append(starts, len(buf))))
    values = _LETTER[LOWER[buf[starts[0] :]]]
    values *= factors[np.minimum(place, longest - 1)]
    hashes = np.add.reduceat(values, starts - starts[0])
    return mixed(hashes + sizes.astype(np.uint64)), np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct 64-bit hashes of its k-word shingles); a row of fewer words has one, a row without words none.

    Two texts of some thousand shingles get an equal hash for different shingles with a chance of about 1e-12.
    """
    for first, buf, offsets in byte_blocks(column):
        hashes, bounds = word_hashes(buf, offsets)
        sums = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        factors = _powers(_SHINGLE, k)
        for t in range(k):
            sums += hashes[t : len(hashes) - k + 1 + t] * factors[t] if len(sums) else sums
        sums = mixed(sums)
        for r in range(len(offsets) - 1):
            a, b = int(bounds[r]), int(bounds[r + 1])
            if b - a >= k:
                s = np.sort(sums[a : b - k + 1])
                keep = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                yield first + r, s[keep]
            elif b > a:
                short = (hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64) + np.uint64(k - b + a)
                yield first + r, mixed(np.array([short], np.uint64))
            else:
                yield first + r, sums[:0]
