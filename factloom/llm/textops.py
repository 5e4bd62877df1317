"""Vectorised text primitives shared by the operators of this subpackage.

All functions work on one UTF-8 buffer that holds the texts of an Arrow batch back to back, and on
numpy arrays of positions in it, so that no Python object is made per word.
Words are maximal runs without the six ASCII white-space bytes, as the contracts define them.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa


@lru_cache(maxsize=1)
def worker_memory() -> None:
    """Set-up of a Python worker, called by tasks and not on the driver: glibc keeps up to 16 MB of freed arrays and gives
    larger ones back to the system, so that neither page faults nor the memory of past tasks pile up."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        for what, value in ((-3, 9 << 20), (-1, 16 << 20), (-8, 2)):  # map threshold, trim threshold, arenas
            libc.mallopt(what, value)


def give_back() -> None:
    """At a task's end: what it freed goes back to the system, for the worker may wait long for its next task."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    pa.default_memory_pool().release_unused()


U64 = np.uint64
WORD_SEP = np.zeros(256, bool)
WORD_SEP[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NO_DOC = np.iinfo(np.int64).max
"""Stands for a null doc_id: such a row comes after all others."""


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Rolling:
    """Polynomial hash modulo 2**64 of spans, through prefix sums; a random table replaces each symbol first."""

    def __init__(self, seed: int, symbols: int = 256):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**63, symbols, dtype=np.uint64) * U64(2) + U64(1) if symbols else None
        self.base = int(rng.integers(1, 2**61)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.pow = self.ipow = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) >= n:
            return
        n = max(n, 2 * len(self.pow), 1 << 16)
        for name, base in (("pow", self.base), ("ipow", self.inverse)):
            out = np.empty(n, U64)
            out[0], done, step = 1, 1, base
            while done < n:
                k = min(done, n - done)
                np.multiply(out[:k], U64(step), out=out[done : done + k])
                step, done = step * step % 2**64, done + k
            setattr(self, name, out)

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int = 1 << 19) -> np.ndarray:
        """Hash of data[s:e] for ascending, not overlapping spans."""
        out = np.empty(len(starts), U64)
        i = 0
        while i < len(starts):
            a = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, a + chunk, "right")))
            b = int(ends[j - 1])
            self._grow(b - a + 1)
            seg = data[a:b]
            sums = np.zeros(b - a + 1, U64)
            np.cumsum((self.table[seg] if self.table is not None else seg) * self.pow[: b - a], out=sums[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (sums[e] - sums[s]) * self.ipow[s] + (e - s).astype(U64)
            i = j
        return mix(out)

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """Hash of each run of `width` values; the caller leaves out windows that cross documents."""
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, U64)
        out = np.zeros(n, U64)
        for k in range(width):
            out *= U64(self.base)
            out += values[k : k + n]
        return mix(out)


BYTES = Rolling(101)
BYTES2 = Rolling(202)


class Texts:
    """The texts of an Arrow array: data (uint8) and offsets (int64, one more than texts); null is empty."""

    def __init__(self, column):
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
        self.null = np.asarray(column.is_null())
        column = column.cast(pa.large_string()).fill_null("") if len(column) else pa.array([], pa.large_string())
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if len(column) and buffers[2] is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]] if len(column) else data
        self.offsets = (offsets - offsets[0]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, for each text, where its words begin (one more than texts)."""
        inside = ~WORD_SEP[self.data]
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
        first = self.offsets[:-1][self.offsets[:-1] < n]
        before[first] = False
        last = self.offsets[1:]
        after[last[last > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all the ranges [start, start + count), one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return shift + np.arange(total)


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Connected components in memory: for each of n nodes the smallest node that links reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    return label
