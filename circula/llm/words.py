"""Words, word hashes and shingle hashes of whole Arrow batches, in numpy.

A word is a run of bytes outside ``\x20`` and ``\x09-\x0D`` (the same as a
run of such code points, as UTF-8 uses those bytes for nothing else).  A null
text has no words.  Hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # text handled at once; one longer document is handled alone
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_R_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_R, _R_INV):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if n > SLICE_BYTES + 1:
            return made[0], made[1]  # for one very long document, not kept
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


class Words:
    """Words of a run of documents: byte ``start`` and ``end`` of each word in
    ``data``, its document ``doc`` (index in the run) and ``first``, the index
    of each document's first word (one more entry at the end)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        n = len(data)
        dark = ~WHITE[data]
        cut = np.zeros(n + 1, bool)
        cut[bounds] = True
        before = np.zeros(n, bool)
        before[1:] = dark[:-1]
        self.start = np.flatnonzero(dark & (~before | cut[:n]))
        after = np.zeros(n, bool)
        after[:-1] = dark[1:]
        self.end = np.flatnonzero(dark & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(bounds) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        powers, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * inverse[self.start])


def runs(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, document bounds in them) for runs
    of about SLICE_BYTES of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, by the first word's index;
    windows that cross documents are for the caller to leave out."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j:j + n]
    return mix(out)
