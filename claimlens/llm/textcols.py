"""Vectorised access to the text of Arrow batches: whole texts as UTF-8 bytes, words and their 64-bit hashes.

A polynomial hash over random byte values, modulo 2**64, is taken of all words of a chunk at once from one running
sum; segments bound the memory that one very long text needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
CHUNK = 1 << 20
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
INV = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_pow: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def powers(n: int) -> list[np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        n = max(n, SEGMENT + 4096)
        _pow[:] = [np.cumprod(np.concatenate(([U(1)], np.full(n - 1, b, np.uint64))), dtype=np.uint64) for b in (BASE, INV)]
    return _pow


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if off else np.zeros(1, np.int64)
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes; a larger text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that `inside` marks; a run ends where its text ends."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    on = inside[data]
    first, last = on.copy(), on.copy()
    first[1:] &= ~on[:-1]
    last[:-1] &= ~on[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    first[cut] = on[cut]
    last[cut - 1] = on[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + SEGMENT, "right")))
        size = int(ends[j - 1] - at)
        pw, inv = powers(size + 1)
        total = np.empty(size + 1, np.uint64)
        total[0] = 0
        np.cumsum(codes[data[at : at + size]] * pw[:size], out=total[1:])
        a, b = starts[i:j] - at, ends[i:j] - at
        out[i:j] = (total[b] - total[a]) * inv[a] + (b - a).astype(np.uint64) * U(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


LOWER_CODES = CODES[LOWER]
WORD = ~SPACE


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ after A-Z are lower-cased, and for each text where its words begin
    among them (one more entry for the end)."""
    starts, ends = spans(data, offsets, WORD)
    return span_hashes(data, starts, ends, LOWER_CODES), np.searchsorted(starts, offsets)


_K = mix(np.arange(1, 65, dtype=np.uint64) * U(0xA0761D6478BD642F)) | U(1)


def shingle_sets(col: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text in turn, the sorted distinct hashes of its k-word shingles; with fewer words, of the whole
    sequence as one; without words, an empty array."""
    data, offsets = utf8(col)
    for lo, hi in chunks(offsets):
        off = offsets[lo : hi + 1] - offsets[lo]
        words, at = word_hashes(data[offsets[lo] : offsets[hi]], off)
        n = len(words)
        total = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            total += words[j : j + len(total)] * _K[j]
        total = mix(total)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                x = np.sort(total[a : b - k + 1])
                yield x[np.concatenate(([True], x[1:] != x[:-1]))]
            elif b > a:
                yield mix((words[a:b] * _K[: b - a]).sum(keepdims=True) + U(b - a))
            else:
                yield np.zeros(0, np.uint64)
