"""Whole Arrow batches of text as flat numpy arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes; splitting bytes at ASCII
white space never cuts a code point. Everything is computed for many documents
at once, in slices of bounded size, so no step runs per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNSTEP = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Slice:
    """Some documents, their bytes end to end; offsets[i]:offsets[i+1] are those of document i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of each word, in order."""
        solid = np.zeros(len(self.data) + self.n + 1, dtype=bool)  # a gap after each document
        spread = np.arange(len(self.data)) + self.doc_of_bytes()
        solid[spread] = ~SPACE[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid))))
        starts, ends = edge[::2], edge[1::2]
        gaps = self.offsets + np.arange(self.n + 1)
        doc = np.searchsorted(gaps, starts, side="right") - 1
        return doc, starts - doc, ends - doc

    def doc_of_bytes(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.offsets))

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        run = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), out=run[1:])
        back = _powers(_UNSTEP, len(data) + 1)
        return mix((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about `limit` bytes; nulls count as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield Slice(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def windows(doc: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of k words inside one document; with fewer words, the whole sequence as one."""
    n = len(doc)
    if n == 0:
        return doc, hashes
    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    size = np.diff(np.concatenate((first, [n])))
    left = np.repeat(first + size, size) - np.arange(n)  # words from here to the document's end
    size_of = np.repeat(size, size)
    start = (left >= k) | ((size_of < k) & (left == size_of))
    at = np.flatnonzero(start)
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(k):
        here = left[at] > i
        word = hashes[np.minimum(at + i, n - 1)]
        out = np.where(here, mix(out * _STEP + word + np.uint64(i + 1)), out)
    return doc[at], out
