"""Vectorised word arithmetic on Arrow string columns.

A word is a maximal run of bytes other than space and \\t..\\r, after lower-casing A-Z. Because UTF-8 continuation bytes
never fall in those ranges, bytes can be scanned without decoding. Word identities are 64-bit polynomial hashes computed
by prefix sums over whole blocks of text, so no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=U)
_powers: dict[str, np.ndarray] = {}


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (splitmix64)."""
    z = z ^ (z >> U(30))
    z = z * U(0xBF58476D1CE4E5B9)
    z ^= z >> U(27)
    z = z * U(0x94D049BB133111EB)
    z ^= z >> U(31)
    return z


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, dtype=U)
                steps[0] = 1
                _powers[key] = np.multiply.accumulate(steps)
    return _powers["p"], _powers["q"]


def tidy(run):
    """Wraps a worker's function over batches: what it has freed goes back to the system when it ends, as workers are kept."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


@dataclass
class Words:
    """Words of several texts: ``bounds[i]:bounds[i + 1]`` are those of text i; starts and ends are byte offsets in ``buf``."""

    h: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    buf: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width, count=len(texts) + texts.offset + 1)[texts.offset :].astype(np.int64)
    raw = texts.buffers()[2]
    buf = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return buf, offsets - offsets[0]


def chunks(texts: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``limit`` bytes (a longer single text is a slice of its own), with the index of their first row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    _, offsets = text_bytes(texts)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, texts.slice(first, last - first)
        first = last


def words_of(texts: pa.Array, lower: bool = True, breaks: str = "space") -> Words:
    """``breaks``: "space", or "punctuation" to end words at any ASCII byte that is neither letter nor digit."""
    buf, offsets = text_bytes(texts)
    low = LOWER[buf] if lower else buf
    n = len(buf)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=U), np.zeros(len(offsets), dtype=np.int64), empty, empty, low, offsets)
    solid = ~(SPACE if breaks == "space" else PUNCTUATION)[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid
    end[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.searchsorted(starts, offsets)
    h = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + BLOCK, side="right"))
        j = max(j, i + 1)
        a, b = starts[i], ends[j - 1]
        p, q = _power_tables(int(b - a) + 1)
        total = np.zeros(int(b - a) + 1, dtype=U)
        np.cumsum((low[a:b].astype(U) + U(1)) * p[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        h[i:j] = mix((total[e] - total[s]) * q[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        i = j
    return Words(h, bounds.astype(np.int64), starts, ends, low, offsets)


def grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words within a text, and the index of each run's first word."""
    n = len(w.h)
    if n < k:
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    last = np.repeat(w.bounds[1:], w.counts())
    at = np.flatnonzero(np.arange(n) + k <= last)
    z = np.zeros(len(at), dtype=U)
    for j in range(k):
        z += w.h[at + j] * _MULS[j]
    return mix(z), at


def shingle_sets(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each text, one after another, and their bounds.

    A text with fewer than k words has the whole sequence as its only shingle; one without words has none.
    """
    z, at = grams(w, k)
    counts = w.counts()
    owner = np.searchsorted(w.bounds, at, side="right") - 1
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        more = np.zeros(len(short), dtype=U)
        for j in range(k - 1):
            has = counts[short] > j
            more[has] += w.h[w.bounds[short[has]] + j] * _MULS[j]
        z = np.concatenate([z, mix(more + counts[short].astype(U) * U(0x2545F4914F6CDD1D))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((z, owner))
    z, owner = z[order], owner[order]
    if len(z):
        keep = np.ones(len(z), dtype=bool)
        keep[1:] = (z[1:] != z[:-1]) | (owner[1:] != owner[:-1])
        z, owner = z[keep], owner[keep]
    return z, np.searchsorted(owner, np.arange(len(counts) + 1)).astype(np.int64)


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds ``values[bounds[i]:bounds[i + 1]]``."""
    width = values.dtype.itemsize
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def crc32_text(ids: np.ndarray) -> np.ndarray:
    """crc32 of each id written in decimal, as Spark's crc32(cast(id as string))."""
    import zlib

    return np.fromiter((zlib.crc32(str(i).encode()) for i in ids.tolist()), dtype=np.int64, count=len(ids))
