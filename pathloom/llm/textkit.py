"""Vectorised text primitives over Arrow string buffers.

Everything works on one flat UTF-8 byte buffer and the offsets of its documents, so the cost per
byte is a few numpy passes and no Python object is made per word.  Hashes are 64-bit polynomial
prefix hashes with a final avalanche; equal words always hash alike, on every worker.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64
#: Text bytes worked on at once; a longer document is worked on alone.
CHUNK_BYTES = 1 << 20

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of the word operators: space and the controls 0x09 to 0x0D.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the classifiers: any ASCII byte but letters and digits.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = False
NOT_ALNUM[48:58] = NOT_ALNUM[65:91] = NOT_ALNUM[97:123] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n at least; grown once per worker."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            np.cumprod(p, out=p)
            _powers[k] = p
    return _powers[0], _powers[1]


def give_back() -> None:
    """Return freed memory to the machine: a Python worker outlives its task, and what it keeps for later counts against its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit avalanche."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of about ``limit`` bytes."""
    flat, offsets = text_buffer(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end, flat[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (codes[k] + 1) * BASE**k over i <= k < j."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * up[: len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end), free of its position."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def word_spans(flat: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never span rows."""
    n = len(flat)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~blank[flat]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def words(flat: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, and its row."""
    starts, ends, rows = word_spans(flat, offsets, blank)
    return span_hash(prefix_hash(LOWER[flat]), starts, ends), rows


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``width`` words, in text order; a row with fewer words gives its whole sequence as one."""
    mult = U64(0xD6E8FEB86659FD93)
    n = len(hashes)
    full = max(n - width + 1, 0)
    acc = np.zeros(full, U64)
    for k in range(width):
        acc = acc * mult + hashes[k : k + full]
    keep = rows[:full] == rows[width - 1 : width - 1 + full] if full else np.zeros(0, bool)
    out, own = mix(acc[keep] + U64(width)), rows[:full][keep]
    count = np.bincount(rows, minlength=n_rows)
    few = np.flatnonzero((count > 0) & (count < width))
    if len(few):
        first = np.searchsorted(rows, few)
        extra = np.zeros(len(few), U64)
        for k in range(width - 1):
            has = count[few] > k
            extra[has] = extra[has] * mult + hashes[first[has] + k]
        out, own = np.concatenate([out, mix(extra + count[few].astype(U64))]), np.concatenate([own, few])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted by hash within the row: (hashes, offsets)."""
    n_rows = len(offsets) - 1
    h, rows = shingles(*words(flat, offsets), n_rows, width)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        h, rows = h[new], rows[new]
    return h, np.searchsorted(rows, np.arange(n_rows + 1))
