"""Array code over the bytes of many texts at once: word bounds, word hashes, word shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: An odd multiplier and its inverse modulo 2**64.
R = 0x9E3779B97F4A7C15
R_INVERSE = pow(R, -1, 2**64)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker's freed memory goes back to the system (workers outlive their tasks)."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return wrapped


def tables(seed: int = 7) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


def powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, U), np.full(n, base, U)]), dtype=U)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(31))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(29))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values end to end, and where each begins (one more than there are); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    at = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes, at least one row each, so working memory follows the largest text only."""
    _, at = bytes_of(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, min(j, len(column))
        i = j


class WordHasher:
    """Words are runs of bytes other than ``blank`` ones; A-Z count as a-z."""

    def __init__(self, blank: bytes = b" \t\n\x0b\x0c\r", word: bytes | None = None):
        inside = np.ones(256, bool)
        inside[list(blank)] = False
        if word is not None:
            inside[:] = False
            inside[list(word)] = True
        self.inside = inside
        self.value = tables()
        self.value[65:91] = self.value[97:123]

    #: Powers for slices of the usual size, shared; a longer text gets its own for as long as it is read.
    usual = 1 << 20
    up = down = None

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.usual:
            return powers(n, R), powers(n, R_INVERSE)
        if WordHasher.up is None:
            WordHasher.up, WordHasher.down = powers(self.usual, R), powers(self.usual, R_INVERSE)
        return WordHasher.up, WordHasher.down

    def words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, document) of every word in order."""
        if not len(raw):
            return np.empty(0, U), np.empty(0, np.int64)
        up, down = self.powers(len(raw))
        inside = self.inside[raw]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        bounds = at[:-1][at[1:] > at[:-1]]
        before[bounds] = False
        after[at[1:][at[1:] > at[:-1]] - 1] = False
        begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        sums = np.empty(len(raw) + 1, U)
        sums[0] = 0
        np.cumsum(self.value[raw] * up[: len(raw)], out=sums[1:])
        h = mixed((sums[end] - sums[begin]) * down[begin])
        return h, np.searchsorted(at, begin, "right") - 1


_PLACES = np.random.default_rng(11).integers(1, 2**63, 8, dtype=np.uint64) * U(2) + U(1)


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each document; a shorter one has its whole word sequence as one."""
    at = np.searchsorted(doc, np.arange(n_docs + 1))
    if len(h) >= k:
        grams = h[: len(h) - k + 1] * _PLACES[0]
        for j in range(1, k):
            grams = grams + h[j : len(h) - k + 1 + j] * _PLACES[j]
        grams = mixed(grams)
    out = []
    for i in range(n_docs):
        a, n = at[i], at[i + 1] - at[i]
        if n >= k:
            out.append(np.unique(grams[a : a + n - k + 1]))
        elif n:
            few = h[a : a + n] * _PLACES[:n]
            total = few.sum(dtype=U, keepdims=True)
            out.append(mixed(total + np.array([n], U) * U(0xD6E8FEB86659FD93)))
        else:
            out.append(np.empty(0, U))
    return out
