"""Vectorised text kernels over Arrow string columns.

A batch of texts is handled as one byte array: words, their hashes and the
hashes of word windows come from table lookups and running sums, so that no
Python object is made for a word.  Batches are cut into blocks of bounded size;
one very long text is a block by itself.

A word's hash is a keyed sum of its 8-byte parts, each mixed with its place;
the hash of several words is a tree of mixes over theirs.  Neither is a
polynomial, so no family of texts collides by its structure.  Two lanes with
keys of their own give 128 bits where equality decides a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that one block may hold, but for a single longer text.
BLOCK_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit words (in new memory)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Keys of the two lanes.
_KEYS = (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB))
_ODD = (U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3))
#: The lowest n bytes of a 64-bit number, n from 0 to 8.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def spans_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash for every raw[start:end] of bytes; equal slices get equal hashes."""
    size = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))  # the 8 bytes from each place on
    out = mix(eight[starts] & _LOW[np.minimum(size, 8)] ^ _KEYS[lane], lane) + size.astype(U) * _ODD[lane]
    long = np.flatnonzero(size > 8)
    if len(long):
        parts = (size[long] - 1) >> 3  # behind the first
        at = np.repeat(starts[long], parts)
        place = ranges(np.ones(len(long), np.int64), parts)
        left = np.repeat(size[long], parts) - 8 * place
        value = mix(eight[at + 8 * place] & _LOW[np.minimum(left, 8)] ^ _KEYS[lane], lane)
        value = mix(value + place.astype(U) * _ODD[1 - lane], 5 + lane)
        out[long] += np.add.reduceat(value, np.cumsum(parts) - parts)
    return mix(out, 3 + lane)


def eight_bytes(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Every slice of at most 7 bytes as one number: its bytes and their count."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray(len(raw) + 1, "<u8", padded, 0, (1,))[starts] & _LOW[size] | size.astype(U) << U(56)


def joined_hash(left: np.ndarray, right: np.ndarray, lane: int = 0) -> np.ndarray:
    """One hash of two, in this order."""
    return mix((left ^ _KEYS[lane]) * _ODD[lane] + mix(right ^ _KEYS[1 - lane], 7 + lane), 9 + lane)


def runs_hash(values: np.ndarray, k: int, lane: int = 0) -> np.ndarray:
    """The hash of every k neighbours in *values*, by doubling: that of twice as
    many is the joint one of two halves."""
    n = len(values) - k + 1
    if n <= 0:
        return values[:0]
    out, done, power, width = None, 0, values, 1
    while True:
        if k & width:
            part = power[done : done + n]
            out = part if out is None else joined_hash(out, part, lane)
            done += width
        if done == k:
            return mix(out, 11 + lane)
        power = joined_hash(power[: len(power) - width], power[width:], lane)
        width *= 2


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets into them; null as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    else:
        column, kind = column.cast(pa.large_string()), np.int64
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Row ranges (first, last+1) whose texts hold at most *most* bytes, or one text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of the texts offsets[0], offsets[1], ... of one block."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, lower: bool = False, hashed: bool = True):
        self.raw = _LOWER[raw] if lower else raw
        self.offsets, n = offsets, len(raw)
        solid = ~_SPACE[raw]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[offsets[offsets <= n]] = True
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        #: first[i] : first[i+1] are the words of text i
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = spans_hash(self.raw, self.starts, self.ends) if hashed else None
        self._second: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def lane(self, lane: int) -> np.ndarray:
        """The words' hashes in one of the two lanes."""
        if lane and self._second is None:
            self._second = spans_hash(self.raw, self.starts, self.ends, 1)
        return self._second if lane else self.hash

    def windows(self, k: int, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all windows of k words that lie within a text."""
        counts = np.maximum(self.counts - (k - 1), 0)
        starts = ranges(self.first[:-1], counts)
        return starts, runs_hash(self.lane(lane), k, lane)[starts] if len(starts) else starts.astype(U)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... with count numbers for each pair, one after the other."""
    total = int(counts.sum())
    out = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else starts, counts)
    return out + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
