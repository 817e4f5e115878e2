"""Vectorised text primitives over Arrow columns: words, word hashes and hashes of word runs.

All functions work on the UTF-8 bytes of a whole column at a time, so that a word costs tens of
nanoseconds and no Python object.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Multiplier of the rolling hash over words, its inverse modulo 2**64, and the constants of the 64-bit finaliser.
BASE = U64(0x9E3779B97F4A7C15)
INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def _table(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: Bytes of words: all but the six ASCII white-space bytes.
NON_SPACE = _table(set(range(256)) - {0x20, *range(0x09, 0x0E)})
#: Bytes of words of letters and digits; every byte of a non-ASCII character counts.
ALNUM = _table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: First byte of the Latin letters of two bytes.
LATIN = 0xC3


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * MIX[0]
        x = (x ^ (x >> U64(27))) * MIX[1]
        return x ^ (x >> U64(31))


@dataclass
class Bytes:
    """The UTF-8 bytes of a text column (with eight zero bytes behind) and where each row begins."""

    data: np.ndarray
    offsets: np.ndarray

    @property
    def used(self) -> np.ndarray:
        return self.data[:-8]

    def lower(self) -> Bytes:
        return Bytes(LOWER[self.data], self.offsets)


def column_bytes(column: pa.Array) -> Bytes:
    """Nulls become empty texts."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return Bytes(np.zeros(8, np.uint8), np.zeros(1, np.int64))
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    size = int(offsets[-1] - offsets[0])
    out = np.zeros(size + 8, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return Bytes(out, offsets - offsets[0])


def plain_rows(text: Bytes) -> np.ndarray:
    """For each row, whether its characters are ASCII or Latin letters of two bytes (but for the signs of times and division)."""
    data = text.used
    high = np.flatnonzero(data >= 0x80)
    first = data[high] == LATIN
    follows = np.zeros(len(high), bool)
    follows[1:] = first[:-1] & (high[1:] == high[:-1] + 1)
    bad = high[~(first | follows) | (follows & ((data[high] == 0x97) | (data[high] == 0xB7)))]
    out = np.ones(len(text.offsets) - 1, bool)
    out[np.searchsorted(text.offsets, bad, "right") - 1] = False
    return out


def lowered(text: Bytes) -> Bytes:
    """Plain texts in lower case."""
    data = LOWER[text.data]
    latin = np.flatnonzero(data[:-1] == LATIN) + 1
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    data[latin] += 0x20
    return Bytes(data, text.offsets)


def give_back() -> None:
    """Memory that was freed goes back to the system. Workers stay for later tasks, and would keep the most that any task has held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about ``limit`` bytes of ``column``, one row at least. After the last it gives memory back."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(int(a), int(b - a))
    give_back()


@dataclass
class Words:
    """Words of a column: byte ranges, and ``rows[i]:rows[i + 1]`` are those of row ``i``."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.rows)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)


def words(text: Bytes, members: np.ndarray = NON_SPACE) -> Words:
    """Maximal runs of the bytes in ``members``; no word spans two rows."""
    inside = members[text.used]
    n = len(inside)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(text.offsets), np.int64))
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = before[1:].copy()
    after[:-1] = inside[1:]
    after[-1] = False
    edges = text.offsets[(text.offsets > 0) & (text.offsets < n)]
    before = before[:-1]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, text.offsets))


def word_hashes(text: Bytes, found: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes; injective for words of up to eight bytes of equal length."""
    if not len(found.starts):
        return np.zeros(0, U64)
    eight = np.ndarray((len(text.data) - 7,), "<u8", text.data, strides=(1,))
    size = found.ends - found.starts
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    with np.errstate(over="ignore"):
        out = mix((eight[found.starts] & masks[np.minimum(size, 8)]) + size.astype(U64) * BASE)
        left, at = np.flatnonzero(size > 8), 8
        while len(left):
            part = eight[found.starts[left] + at] & masks[np.minimum(size[left] - at, 8)]
            out[left] = mix(out[left] * BASE + part)
            at += 8
            left = left[size[left] > at]
    return out


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive hashes, by first position. Runs across rows are included."""
    n = len(hashes)
    if n < length:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        if length <= 8:
            out = hashes[: n - length + 1].copy()
            for k in range(1, length):
                out = out * BASE + hashes[k : n - length + 1 + k]
            return mix(out)
        power = np.full(n, BASE, U64)
        power[0] = 1
        back = np.full(n, INVERSE, U64)
        back[0] = 1
        sums = np.zeros(n + 1, U64)
        np.cumsum(hashes * np.cumprod(power), out=sums[1:])
        return mix((sums[length:] - sums[:-length]) * np.cumprod(back)[: n - length + 1])


def whole_runs(rows: np.ndarray, length: int) -> np.ndarray:
    """For each position that begins a run: whether the run stays inside its row."""
    n = int(rows[-1])
    if n < length:
        return np.zeros(0, bool)
    out = np.ones(n, bool)
    for k in range(1, length):
        ends = rows[1:] - k
        out[ends[ends >= 0]] = False
    return out[: n - length + 1]


def joined(text: Bytes, found: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words, each followed by a space, and their byte ranges in that string."""
    size = found.ends - found.starts
    stop = np.cumsum(size + 1)
    out = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    if len(size):
        source = np.repeat(found.starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        target = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
        out[target] = text.data[source]
    return out.tobytes(), stop - 1 - size, stop - 1
