"""Vectorised words and shingle hashes over Arrow string columns (helpers that run inside tasks).

Words are maximal runs without ASCII white space (``[^\\x20\\x09-\\x0D]+``). White space is ASCII, so
UTF-8 bytes can be scanned directly. A null text has no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"[^\x20\x09-\x0D]+"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser for 64-bit integers (shift-multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (max(n, 1) - 1).bit_length())
        have = np.full(size, np.uint64(base), dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


class Words:
    """The words of a column of texts: doc (row of each word), start and end (byte offsets into data)."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
        column = column.fill_null(b"") if column.null_count else column
        self.rows = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + self.rows + 1]
        raw = column.buffers()[2]
        base = int(offsets[0]) if self.rows else 0
        size = int(offsets[-1]) - base if self.rows else 0
        self.data = np.frombuffer(raw, dtype=np.uint8)[base : base + size] if size else np.zeros(0, dtype=np.uint8)
        self.offsets = offsets - base if self.rows else np.zeros(1, dtype=np.int64)
        inside = (self.data != 0x20) & (self.data - np.uint8(9) > 4)  # not in _SPACE
        bounds = self.offsets[(self.offsets > 0) & (self.offsets < size)]  # a word ends where its text ends
        before, after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[bounds], after[bounds - 1] = False, False
        self.start = np.flatnonzero(inside > before)
        self.end = np.flatnonzero(inside > after) + 1
        self.counts = np.diff(np.searchsorted(self.start, self.offsets)) if self.rows else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(self.rows), self.counts)
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; with lower, of the word with A-Z lower-cased."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        out = np.empty(len(self.start), dtype=np.uint64)
        step = 1 << 13  # of words, so that the temporary arrays stay in the cache
        for k in range(0, len(self.start), step):
            s, e = self.start[k : k + step], self.end[k : k + step]
            lo, hi = int(s[0]), int(e[-1])
            terms = _LETTER[data[lo:hi]] * _powers(_BASE, hi - lo)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
            out[k : k + step] = (sums[e - lo] - sums[s - lo]) * _powers(_INVERSE, hi - lo + 1)[s - lo]
            out[k : k + step] += (e - s).astype(np.uint64)
        return mix(out)

    def code_points(self) -> np.ndarray:
        """Code points in words, per text."""
        lead = (self.data & 0xC0) != 0x80
        lead &= ~_SPACE[self.data]
        return self.per_text(lead)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag per byte over each text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def windows(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay in one group, and their first word's position.

    first holds the position at which each group begins, and the end."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + hashes[k : k + m]
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(m) + n <= ends[:m])
    return mix(out[at]), at


def least(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest of every n values in a row, and the place of the first such one."""
    low, place, have = values, np.arange(len(values)), 1
    while have < n:
        step = min(have, n - have)
        less = low[step:] < low[:-step]  # of equal ones the first
        low, place, have = np.where(less, low[step:], low[:-step]), np.where(less, place[step:], place[:-step]), have + step
    return low, place


def shingles(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """All n-word shingles with their group; a group of 1 to n-1 words has its whole sequence as one."""
    found, at = windows(hashes, first, n)
    sizes = np.diff(first)
    group = np.repeat(np.arange(len(sizes)), sizes)[at] if len(at) else np.zeros(0, np.int64)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            there = sizes[short] > k
            at_k = np.minimum(first[short] + k, len(hashes) - 1)
            whole = np.where(there, whole * np.uint64(_BASE) + hashes[at_k], whole)
        whole = mix(whole + sizes[short].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        found, group = np.concatenate((found, whole)), np.concatenate((group, short))
    return found, group


def distinct_sets(values: np.ndarray, group: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted and distinct within each group, one group after another, and where each begins."""
    if len(group) and (group[1:] < group[:-1]).any():
        order = np.argsort(group, kind="stable")
        v, g = values[order], group[order]
    else:
        v, g = values.copy(), group
    bounds = np.concatenate(([0], np.cumsum(np.bincount(g, minlength=rows)))) if rows else np.zeros(1, np.int64)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo > 1:
            v[lo:hi].sort()
    if len(v):
        new = np.concatenate(([True], (v[1:] != v[:-1]) | (g[1:] != g[:-1])))
        v, g = v[new], g[new]
    return v, np.concatenate(([0], np.cumsum(np.bincount(g, minlength=rows)))).astype(np.int64)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others have none
#: What a task's process keeps for the next task of the same operator, as it costs much to load.
HELD: dict[object, object] = {}


def give_back() -> None:
    """Returns freed memory to the system. A task's process outlives the task, and Spark keeps more of them than run at a time."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def let_go() -> None:
    """Frees what an operator has left in this task's process."""
    HELD.clear()
    give_back()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 19, holds: bool = False) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of a text column (one row at least), to bound memory.

    holds: whether the task uses HELD; others free it first."""
    if not holds:
        let_go()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    del batches
    give_back()


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
