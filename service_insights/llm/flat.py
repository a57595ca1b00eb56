"""Vectorised word splitting and hashing of Arrow string columns.

A column's UTF-8 bytes are handled as one flat array: word bounds come from a
byte table, word hashes from one prefix sum, window hashes from word hashes.
No Python object is made per word.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_M1, _M2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Bytes of text handled at a time; the arrays of a slab take about 50 times this at most.
SLAB_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise (changes and returns a new array)."""
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^j and p^-j for j < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, p in enumerate((_P, _P_INV)):
            x = np.full(size, p, _U)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=_U)
    return _POWERS[0][:n], _POWERS[1][:n]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[start:end] for each range; ``values`` are random words, one per symbol."""
    n = len(values)
    p, inv = _powers(n + 1)
    acc = np.zeros(n + 1, _U)
    np.cumsum(values * p[:n], out=acc[1:])
    return mix((acc[ends] - acc[starts]) * inv[starts] + (ends - starts).astype(_U) * _M2)


def table(pattern_bytes, lower: bool) -> np.ndarray:
    """256 entries: 0 for separators, else the byte (A-Z lower-cased when asked)."""
    t = np.zeros(256, np.uint8)
    for b in pattern_bytes:
        t[b] = b + 32 if lower and 65 <= b <= 90 else b
    return t


_BLANK = {0x20, *range(0x09, 0x0E)}
#: Words between ASCII blanks, as they are and with A-Z lower-cased. Byte 0 is a letter like any other.
PLAIN = table([b for b in range(256) if b not in _BLANK], False)
PLAIN_LOWER = table([b for b in range(256) if b not in _BLANK], True)
#: Words of 0-9, a-z and every non-ASCII character, A-Z lower-cased.
ALNUM_LOWER = table([b for b in range(256) if b >= 0x80 or chr(b).isalnum()], True)
_WORDLIKE = {id(PLAIN): np.array([b not in _BLANK for b in range(256)]), id(PLAIN_LOWER): np.array([b not in _BLANK for b in range(256)])}
_RANDOM = mix(np.arange(1, 257, dtype=_U) * _P)


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 bounds of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    lo, hi = int(offs[0]), int(offs[-1])
    data = np.frombuffer(col.buffers()[2], np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return data, offs - lo


class Words:
    """Words of a string column: ``starts``/``ends`` in ``data``; row r has words bounds[r]:bounds[r + 1]."""

    def __init__(self, col: pa.Array, kind: np.ndarray):
        raw, rows = flat_bytes(col)
        self.raw, self.rows = raw, rows
        self.data = kind[raw]
        n = len(raw)
        word = _WORDLIKE[id(kind)][raw] if id(kind) in _WORDLIKE else self.data != 0
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        left = np.ones(n, bool)
        left[1:] = ~word[:-1]
        right = np.ones(n, bool)
        right[:-1] = ~word[1:]
        self.starts = np.flatnonzero(word & (left | edge[:-1]))
        self.ends = np.flatnonzero(word & (right | edge[1:])) + 1
        self.bounds = np.searchsorted(self.starts, rows)
        self.n = len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row(self) -> np.ndarray:
        """Row of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return range_hash(_RANDOM[self.data], self.starts, self.ends)

    def prefix_hashes(self, lengths: tuple[int, ...]) -> list[np.ndarray]:
        """For each length k, hashes of the words' first k bytes (shorter words: 0)."""
        values, out = _RANDOM[self.data], []
        n = len(values)
        p, inv = _powers(n + 1)
        acc = np.zeros(n + 1, _U)
        np.cumsum(values * p[:n], out=acc[1:])
        for k in lengths:
            ends = np.minimum(self.starts + k, self.ends)
            h = mix((acc[ends] - acc[self.starts]) * inv[self.starts] + np.full(1, k, _U) * _M1)
            out.append(np.where(self.ends - self.starts >= k, h, _U(0)))
        return out


def windows(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of h[i:i + k] for each i (len(h) - k + 1 entries, none when shorter), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    part, size, out, done = mix(h + _U((seed * 0xD6E8FEB86659FD93 + 1) & (2**64 - 1))), 1, None, 0
    while True:
        if k & size:
            piece = part[done:done + n]
            out = piece.copy() if out is None else mix(out * _P + piece)
            done += size
        if size * 2 > k:
            return out
        part = mix(part[:-size] * _M1 + part[size:])
        size *= 2


def window_rows(bounds: np.ndarray, k: int) -> np.ndarray:
    """Positions i such that words i..i + k - 1 lie in one row."""
    counts = np.maximum(np.diff(bounds) - k + 1, 0)
    total = int(counts.sum())
    first = np.repeat(bounds[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(total)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLAB_BYTES, rows: int = 4095) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column has about ``limit`` bytes in each, with 1 to ``rows`` rows. Texts stay whole."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, base + limit, "right"))))
            yield batch.slice(at, to - at)
            at = to


def gather_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of starts[0]..starts[0] + lengths[0], then of the next range, and so on."""
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


def list_array(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
