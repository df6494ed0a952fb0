"""Vectorised word splitting and hashing over Arrow string columns.

Helpers for the operators of this subpackage.  Everything here works on one Arrow batch inside a Spark
task; documents are processed in slices of bounded size, so temporary arrays stay small even when a batch
holds very long texts.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  Splitting on bytes equals splitting on
characters, because UTF-8 never uses those bytes inside a longer sequence.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES, HASH_BYTES = 2 << 20, 1 << 19
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PLACES = 1 << 16
_WORD_P = U64(0xD6E8FEB86659FD93)
_lanes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** (0..n-1)`` modulo 2**64; the longest array asked for is kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * HASH_BYTES:
            _powers[int(base)] = have
    return have[:n]


def _lane(lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Random odd numbers for each byte value and for each place in a word; every lane has its own."""
    if lane not in _lanes:
        rnd = np.random.default_rng(20240229 + lane)
        _lanes[lane] = tuple(rnd.integers(1, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1) for n in (256, _PLACES))
    return _lanes[lane]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    h = h ^ (h >> U64(33))
    h *= U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs.astype(np.int64) - int(offs[0])


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``limit`` bytes (one row at least)."""
    _, offs = text_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
    tidy()


def tidy() -> None:
    """Give freed memory back: Python workers are kept between tasks, and two or more share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


class Words:
    """Words of a run of texts: byte bounds ``start`` and ``end``, and the first word of each row in ``row``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw, self.offs = text_bytes(column)
        self.raw = _LOWER[raw] if lower else raw
        inside = ~_SPACE[self.raw]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = self.offs[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(closes) + 1
        self.row = np.searchsorted(self.start, self.offs)
        self.n = len(self.start)

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.row)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), self.per_row)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """64-bit hash of each word's bytes, over runs of words of about ``HASH_BYTES``; lanes are independent of each other.

        A byte's random number is multiplied by one of its place, so no pattern of repeated bytes makes two words equal.
        """
        of_byte, of_place = _lane(lane)
        out, first = np.empty(self.n, np.uint64), 0
        while first < self.n:
            base = self.start[first]
            last = max(first + 1, int(np.searchsorted(self.end, base + HASH_BYTES, "right")))
            start, end = self.start[first:last] - base, self.end[first:last] - base
            n = int(end[-1])
            place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
            factor = of_place[place & (_PLACES - 1)]
            if n > _PLACES and int((end - start).max()) > _PLACES:
                factor = factor * (mix((place >> 16).astype(np.uint64) + U64(1)) | U64(1))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(of_byte[self.raw[base : base + n]] * factor, out=sums[1:])
            out[first:last] = mix(sums[end] - sums[start] + (end - start).astype(np.uint64) * of_place[-1])
            first = last
        return out

    def kept_text(self, keep: np.ndarray) -> list[bytes]:
        """Per row, the words marked in ``keep`` joined by one space."""
        out, raw = [], self.raw.tobytes()
        kept = np.flatnonzero(keep)
        first = np.searchsorted(kept, self.row)
        start, end = self.start[kept].tolist(), self.end[kept].tolist()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(b" ".join([raw[s:e] for s, e in zip(start[a:b], end[a:b])]))
        return out


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` values from each position on (the last ``k - 1`` positions are cut)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, done, part, size = None, 0, h, 1
    while True:
        if k & size:
            if out is None:
                out, done = part, size
            else:
                n = min(len(part), len(out) - size) if len(out) > size else 0
                out = part[:n] + out[size : size + n] * powers(_WORD_P, size + 1)[size]
                done += size
        if done == k:
            return mix(out[: len(h) - k + 1])
        m = len(part) - size
        part = part[:m] + part[size:] * powers(_WORD_P, size + 1)[size]
        size *= 2


def first_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost smallest value of each ``width`` values."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, size = np.arange(len(h)), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(h[right] < h[left], right, left)
        size += step
    return best[:n]
