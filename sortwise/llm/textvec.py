"""Vectorised text kernels over Arrow string columns (numpy, inside tasks).

A batch is worked through in slices of a few megabytes of text, whole documents
each, so memory stays bounded whatever the Arrow batch holds.  Words are runs of
bytes outside ``[\\x20\\x09-\\x0D]``; that set is ASCII, so byte and character
boundaries agree in UTF-8.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WHITE_BYTES = b" \t\n\x0b\x0c\r"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MULT, -1, 1 << 64)
_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = 1 << max(n - 1, 65535).bit_length()
        with np.errstate(over="ignore"):
            p = np.full(size, _MULT, dtype=np.uint64)
            q = np.full(size, _INV, dtype=np.uint64)
            p[0] = q[0] = 1
            p, q = np.cumprod(p), np.cumprod(q)
        if size > 4 * SLICE_BYTES:  # one huge text: do not keep its table
            return p, q
        _pow, _inv = p, q
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each ``symbols[start:end]``; equal spans get equal hashes
    wherever they stand.  One cumulative sum serves all spans."""
    p, q = _powers(len(symbols) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * p[: len(symbols)], out=acc[1:])
        return mix((acc[ends] - acc[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


#: Bytes of text after which a worker gives free memory back.
RELEASE = 8 << 20
_read = 0


def release(size: int) -> None:
    """Give the allocators' free pages back to the system after every ``RELEASE`` bytes of
    text: an executor's Python workers live on between stages beside its heap."""
    global _read
    _read += size
    if _read >= RELEASE:
        _read = 0
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)


def tidy(run):
    """``run``, a task's function over batches, that gives free memory back at its end."""
    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release(RELEASE)
    return whole


def tidy_group(run):
    """The same for a function over the rows of one key."""
    def whole(key, table):
        try:
            return run(key, table)
        finally:
            release(RELEASE)
    return whole


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts with at
    most ``most`` bytes, or one longer text."""
    if len(column) == 0:
        return
    data, offsets = utf8(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        release(int(offsets[hi] - offsets[lo]))
        lo = hi


def runs(ink: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text index of every maximal run of set flags inside one text."""
    if not len(ink):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    first = offsets[:-1]
    before[first[first < len(ink)]] = False
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts = np.flatnonzero(ink & ~before)
    ends = np.flatnonzero(ink & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text index of every word, in order."""
    return runs(~WHITE[data], offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every word."""
    starts, ends, doc = word_spans(data, offsets)
    return span_hashes(data, starts, ends), doc


def windows(words: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start index of every window of ``size`` words inside one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(doc[:n] == doc[size - 1:])
    acc = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            acc = acc * np.uint64(_MULT) + words[at + k]
    return mix(acc + np.uint64(size)), at
