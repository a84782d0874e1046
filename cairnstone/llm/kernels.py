"""Vectorised text kernels over Arrow batches: word spans and 64-bit hashes straight from UTF-8 bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text handled at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x + U(seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & _MASK)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(256, dtype=U), 7)
_powers: dict[int, list[np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 1 << 16), U(b))
            x[0] = U(1)
            out.append(np.multiply.accumulate(x))
        have = out
        if n <= 5 * SLICE_BYTES // 4:  # those of a larger slice are not kept: a worker outlives its task
            _powers[base] = out
    return have[0][:n], have[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def cut(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about limit bytes of text and at most so many rows."""
    if not batch.num_rows:
        return
    _, offsets = texts(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, at + rows)
        yield batch.slice(at, end - at)
        at = end


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES, rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """All batches, cut; at the end freed memory goes back to the system."""
    for batch in batches:
        yield from cut(batch, text, limit, rows)
    release()


def release() -> None:
    """Gives freed memory and the tables of powers back to the system; a Python worker outlives its task."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes, and first word of each text (n + 1 values)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = word[data]
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    after[-1] = False
    full = np.flatnonzero(np.diff(offsets))
    before = before[:-1]
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by its bytes alone."""
    if not len(starts):
        return np.zeros(0, U)
    p, q = powers(_BASE, len(data) + 1)
    total = np.empty(len(data) + 1, U)
    total[0] = 0
    np.cumsum(_BYTE[data] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(U))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k consecutive values; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    c = _BASE
    for i in range(k):
        out *= U(c)
        out += h[i : i + n]
    return mix(out, seed)


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """As grams, for long k: prefix sums of h * base**i."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    p, q = powers(base | 1, len(h) + 1)
    total = np.empty(len(h) + 1, U)
    total[0] = 0
    np.cumsum(h * p[:-1], out=total[1:])
    return mix((total[k:] - total[:n]) * q[:n])


def window_min(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    n, m, size = len(g) - w + 1, g, 1
    if n <= 0:
        return np.zeros(0, g.dtype)
    while size * 2 <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[:n], m[w - size : w - size + n])


def inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the n - k + 1 windows of k words lie in one text; first: first word of each text."""
    ok = np.zeros(max(n - k + 1, 0), bool)
    left = np.zeros(n + 1, np.int32)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    has = counts > 0
    np.add.at(left, first[:-1][has], 1)
    np.add.at(left, first[:-1][has] + counts[has], -1)
    ok[:] = np.cumsum(left)[: len(ok)] > 0
    return ok


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def in_bitmap(bits: np.ndarray, bits_log2: int, keys: np.ndarray) -> np.ndarray:
    at = keys.view(U) & U((1 << bits_log2) - 1)
    return (bits.view(U)[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1


def bits_of(bits: np.ndarray) -> int:
    """Bits (log2) of a filter of longs."""
    return (64 * len(bits)).bit_length() - 1
