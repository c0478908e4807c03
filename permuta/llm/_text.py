"""Byte-level text kernels in numpy, shared by the operators that run inside Arrow batches.

A batch of texts is one flat byte array plus offsets.  Words are maximal runs of bytes that a
256-entry table accepts; their 64-bit hashes are polynomial sums over the whole array, so no
Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; the numpy temporaries are a small multiple of it.
CHUNK = 1 << 20

_ALL = np.arange(256)
#: A-Z to a-z, every other byte to itself.
FOLD = np.where((_ALL >= 65) & (_ALL <= 90), _ALL + 32, _ALL).astype(np.uint8)
#: Bytes of a word in ``[^\x20\x09-\x0D]+``.
NOT_SPACE = ~((_ALL == 32) | ((_ALL >= 9) & (_ALL <= 13)))
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))


def release() -> None:
    """Give memory that a task has freed back to the system: workers are used again by later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_30, _27, _31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (multiply, xor-shift)."""
    x = x ^ (x >> _30)
    x *= _MIX
    x ^= x >> _27
    x *= _MIX2
    x ^= x >> _31
    return x


def flat(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col) or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes: first row, end row, their bytes and offsets."""
    n, a = len(off) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes of all words, and for each text the range of its words."""
    k = keep[data]
    start = k.copy()
    start[1:] &= ~k[:-1]
    at = off[:-1]
    at = at[at < len(data)]
    start[at] = k[at]
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, off)


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base``: of 0 to 1023, and of the multiples of 1024 up to ``n``."""
    low = np.full(1025, base, np.uint64)
    low[0] = 1
    np.cumprod(low, out=low)
    high = np.full((n + 1023) // 1024, low[-1], np.uint64)
    high[:1] = 1
    return low[:-1], np.cumprod(high, out=high)


def word_hashes(data: np.ndarray, starts: np.ndarray, keep: np.ndarray, fold: np.ndarray = FOLD) -> np.ndarray:
    """A 64-bit hash of each word; equal words hash alike wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    low, high = _powers(_P, len(data))
    power = np.multiply.outer(high, low).ravel()[: len(data)]
    power *= np.where(keep, _BYTE[fold], np.uint64(0))[data]
    sums = np.add.reduceat(power, starts)
    low, high = _powers(_P_INV, len(data))
    return mix(sums * high[starts >> 10] * low[starts & 1023])


_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of one text's word hashes; a text of fewer words is one shingle."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return mix(np.array([np.sum(h * _STEP[:n]) + np.uint64(n)], np.uint64))
    out = h[: n - k + 1] * _STEP[0]
    for i in range(1, k):
        out += h[i : n - k + 1 + i] * _STEP[i]
    out += np.uint64(k)
    return mix(out)


def documents(batch: pa.RecordBatch, column: str, keep: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and word hashes of each text of a batch."""
    for a, b, data, off in chunks(*flat(batch.column(column))):
        starts, at = words(data, off, keep)
        h = word_hashes(data, starts, keep)
        for i in range(b - a):
            yield a + i, h[at[i] : at[i + 1]]
