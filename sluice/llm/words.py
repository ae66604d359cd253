"""Vectorised word splitting and hashing over whole Arrow text columns.

A word is a maximal run of bytes other than U+0020 and U+0009-U+000D, after
A-Z have been lower-cased.  All functions work on the UTF-8 bytes of an Arrow
string column at once, so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E6C63D0876A9A4F)
#: One odd 64-bit value for each byte, so that short words differ in all bits.
_BYTE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE[_LOWER]

EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64: a bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-dependent hash of two hashes."""
    return mix(left * np.uint64(0x2545F4914F6CDD1D) + mix(right ^ np.uint64(0x632BE59BD9B4E019)))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def tidy() -> None:
    """Gives freed memory back to the system: workers stay for later stages, and others use their executor meanwhile."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(column: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The whole column as (bytes, offsets) of texts in turn, `size` bytes or one text at a time."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    tidy()


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last) of every word, and n+1 offsets into the words by text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    solid = ~_SPACE[data]
    apart = edge[1:-1]
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1] | apart
    ends[:-1] &= ~solid[1:] | apart
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, last, np.searchsorted(first, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE and its inverse modulo 2**64 to the powers 0..n-1; kept by the worker."""
    global _POWER
    if len(_POWER[0]) < n:
        n = 1 << (n - 1).bit_length()
        both = []
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 2**64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWER = tuple(both)
    return _POWER


_POWER: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span of the bytes: equal bytes (lower-cased if asked), equal values.

    A polynomial in the byte values, normalised to the span's start.  Spans
    ascend and do not overlap.  About a MB is hashed at a time, so that the
    tables of powers stay small.
    """
    out = np.empty(len(first), np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + (1 << 20), side="right")))
        base = first[i]
        a, b = first[i:j] - base, last[i:j] - base
        value = table[data[base : last[j - 1]]]
        up, down = _powers(len(value))
        value *= up[: len(value)]
        edges = np.empty(2 * len(a), np.int64)
        edges[0::2], edges[1::2] = a, b
        total = np.add.reduceat(value, edges[:-1])[0::2]
        out[i:j] = mix(total * down[a] + (b - a).astype(np.uint64))
        i = j
    return out


def word_hashes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and n+1 offsets by text."""
    found, counts = [], [np.zeros(1, np.int64)]
    for data, offsets in blocks(column):
        first, last, by_text = spans(data, offsets)
        found.append(span_hashes(data, first, last))
        counts.append(np.diff(by_text))
    return np.concatenate(found or [EMPTY]), np.cumsum(np.concatenate(counts))


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of `width` words of each text, sorted, and n+1 offsets.

    A text with fewer words has its whole sequence as one shingle; a text
    without words has none.
    """
    words, at = word_hashes(column)
    n_words = np.diff(at)
    count = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    out = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    begin = np.arange(int(count.sum()), dtype=np.int64) - np.repeat(out, count) + np.repeat(at[:-1], count)
    limit = np.repeat(at[1:], count)
    got = np.full(len(begin), width, np.uint64)
    for k in range(width):
        inside = begin + k < limit
        nxt = words[np.minimum(begin + k, max(len(words) - 1, 0))] if len(words) else EMPTY
        got = np.where(inside, chain(got, nxt), got)
    # Sorting by (owner, value): values first, then a stable pass over small integers.
    order = np.argsort(got)
    order = order[np.argsort(owner[order].astype(np.uint16 if len(count) < 65536 else np.int64), kind="stable")]
    got, owner = got[order], owner[order]
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
    got, owner = got[keep], owner[keep]
    return got, np.searchsorted(owner, np.arange(len(count) + 1))
