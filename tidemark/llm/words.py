"""Vectorised words, word hashes and shingles over Arrow string columns.

A word is a maximal run of bytes outside space and \\t..\\r. Texts of a block are handled in one
numpy pass; no word, shingle or window crosses from one text into the next.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
STEP = np.uint64(0xD6E8FEB86659FD93)
BLOCK_BYTES = 1 << 19

#: one pair of constants a lane: lanes give independent hashes of the same words
_LANES = [(np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)), (np.uint64(0xD1342543DE82EF95), np.uint64(0x8CB92BA72F3D8DD7))]


def release() -> None:
    """Give freed memory back to the machine: workers live on after their tasks, several to an executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """``run`` over batches, and ``release`` when it has ended."""

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text makes a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the index of each text's first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[1:] > offs[:-1]
    a, z = offs[:-1][full], offs[1:][full] - 1
    first[a] = inside[a]
    last[z] = inside[z]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of each span's bytes (no span is empty), alike wherever the span stands.

    A span is read in pieces of eight bytes; each piece goes with its number through the mixer before the
    sum, so no algebra of the bytes survives. Spans of one piece never share a hash.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    a, c = _LANES[lane]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data),), "<u8", padded.data, 0, (1,))
    lens = (ends - starts).astype(np.int64)
    pieces = (lens + 7) >> 3
    firsts = np.cumsum(pieces) - pieces
    if int(pieces.max()) == 1:
        at, left, no = starts, lens, np.zeros(1, np.uint64)
    else:
        no = np.arange(int(pieces.sum())) - np.repeat(firsts, pieces)
        at, left = np.repeat(starts, pieces) + 8 * no, np.repeat(lens, pieces) - 8 * no
    value = eight[at]
    value &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
    value = mix((value + c) ^ mix(no.astype(np.uint64) * STEP + a))
    if len(value) > len(starts):
        value = np.add.reduceat(value, firsts)
    return mix(value + lens.astype(np.uint64) * a)


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``size`` words from each word on, and whether that window stays in its text."""
    n = len(hashes)
    ok = np.zeros(n, bool)
    if n >= size:
        doc_end = np.repeat(first[1:], np.diff(first))
        ok = np.arange(n) + size <= doc_end
        acc = hashes[: n - size + 1].copy()
        for j in range(1, size):
            acc = acc * STEP + hashes[j : n - size + 1 + j]
        out = np.zeros(n, np.uint64)
        out[: n - size + 1] = mix(acc)
        return out, ok
    return np.zeros(n, np.uint64), ok


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct word-shingle hashes of each text; one of all its words if it has fewer than ``size``."""
    starts, ends, first = spans(data, offs)
    hashes = word_hashes(data, starts, ends)
    wide, ok = windows(hashes, first, size)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= size:
            out.append(np.unique(wide[a : z - size + 1]))
        elif z > a:
            acc = np.uint64(z - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:z]:
                    acc = acc * STEP + h
            out.append(mix(np.array([acc], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
