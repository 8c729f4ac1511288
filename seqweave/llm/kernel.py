"""Vectorised text primitives over Arrow string arrays: words, hashes and n-grams of many texts at once.

Texts stay UTF-8 bytes. Work is cut into chunks of about CHUNK bytes, whole texts each, so that memory is bounded by
a chunk or by the longest text.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BYTE_FOLDED = BYTE.copy()
BYTE_FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
R = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def give_back() -> None:
    """Return to the system what this process no longer needs: tables of powers, Arrow's pool, the heap's free pages."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work):
    """work(batches) for mapInArrow; when a task ends, its worker process gives back the memory that it no longer needs."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def windows_hash(x: np.ndarray, k: int, base: int = R) -> np.ndarray:
    """Hash of x[i:i+k] for every i that has k elements."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    if k <= 6:
        h = np.zeros(n, dtype=np.uint64)
        for t in range(k):
            h = h * U(base) + x[t : t + n]
        return mix(h)
    p = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(x * powers(base, len(x)), dtype=np.uint64)))
    return mix((p[k:] - p[:-k]) * powers(inverse(base), n))


def as_strings(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def raw(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is empty."""
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if array.buffers()[2] is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def chunks(array: pa.Array, limit: int = CHUNK):
    """(first, last + 1) of runs of texts with about limit bytes."""
    if not len(array):
        return
    at = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a chunk: start, end (bytes), hash; first[d] .. first[d + 1] are those of text d."""

    def __init__(self, array: pa.Array, fold_case: bool = False, hashes: bool = True):
        self.data, self.at = data, at = raw(array)
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[at] = True
        before = np.ones(n, dtype=bool)
        before[1:] = ~solid[:-1]
        before |= edge[:n]
        after = np.ones(n, dtype=bool)
        after[:-1] = ~solid[1:]
        after |= edge[1:]
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, at)
        if hashes:
            p = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((BYTE_FOLDED if fold_case else BYTE)[data] * powers(R, n), dtype=np.uint64)))
            self.hash = mix((p[self.end] - p[self.start]) * powers(inverse(R), n + 1)[self.start] + (self.end - self.start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for every full window, by doubling."""
    span, m = 1, x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the first minimum of x[i:i+w] for every full window, by doubling."""
    lower = lambda a, b: np.where(x[b] < x[a], b, a)
    span, at = 1, np.arange(len(x))
    while span * 2 <= w:
        at = lower(at[:-span], at[span:])
        span *= 2
    rest = w - span
    return lower(at[: len(at) - rest], at[rest:]) if rest else at


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, .. (n[0] of them), then those of at[1], and so on."""
    upto = np.cumsum(n)
    return np.repeat(at - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)


def sliding_max(x: np.ndarray, w: int) -> np.ndarray:
    span, m = 1, x
    while span * 2 <= w:
        m = np.maximum(m[:-span], m[span:])
        span *= 2
    rest = w - span
    return np.maximum(m[: len(m) - rest], m[rest:]) if rest else m


def byte_ngrams(data: np.ndarray, order: int, bits: int, salt: int) -> np.ndarray:
    """Bucket of data[i:i+order] for every i, in 2**bits buckets; white space counts as one kind of byte."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    code = FOLD[data].astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for t in range(order):
        h = (h << U(8)) | code[t : t + n]
    return (((h + U(salt)) * U(R)) >> U(64 - bits)).astype(np.int64)


FOLD = np.arange(256, dtype=np.uint8)
FOLD[SPACE] = 32
FOLD_CASE = FOLD.copy()
FOLD_CASE[ord("A") : ord("Z") + 1] += 32
