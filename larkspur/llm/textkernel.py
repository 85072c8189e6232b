"""Vectorised word handling on Arrow string columns: words, 64-bit word hashes, shingle sets.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D of the UTF-8 text.  All
functions see whole texts; long columns are handled half a megabyte at a time, a longer text by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    white = np.zeros(256, bool)
    white[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    return white, lower


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64 for i < n."""
    both = []
    for b in (_BASE, _BASE_INVERSE):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(table: pa.RecordBatch | pa.Table, *texts: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Runs of rows with about `most` bytes in the columns `texts`, a longer row by itself."""
    size = np.zeros(table.num_rows, np.int64)
    for name in texts:
        size += pc.fill_null(pc.binary_length(table.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < table.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
        yield table.slice(at, to - at)
        at = to


def once(ids: pa.Array, texts: pa.Array, f: Callable[[pa.Array], object]) -> tuple[object, np.ndarray]:
    """f of the texts where each run of rows with an id and a text has it once, and for each row its place there."""
    n = len(ids)
    new = np.ones(n, bool)
    if n > 1:
        same = pc.and_kleene(pc.equal(ids[1:], ids[:-1]), pc.equal(texts[1:], texts[:-1]))
        new[1:] = ~pc.fill_null(same, False).to_numpy(zero_copy_only=False)
    return f(texts.take(pa.array(np.flatnonzero(new)))), np.cumsum(new) - 1


class Words:
    """The words of a column: data (bytes), start and end of each word, first[i] the index of text i's first word, hash of each word."""

    def __init__(self, column: pa.Array, lower: bool):
        white, table = _tables()
        data, offsets = text_bytes(column)
        n = len(data)
        inside = ~white[data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        after[(offsets[1:] - 1)[offsets[1:] > 0]] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.data = table[data] if lower else data
        self.offsets = offsets
        self.first = np.searchsorted(self.start, offsets)
        power, self._inverse = powers(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=self._sums[1:])
        self._hash()

    def _hash(self) -> None:
        size = (self.end - self.start).astype(np.uint64)
        self.hash = mix((self._sums[self.end] - self._sums[self.start]) * self._inverse[self.start] + size * np.uint64(0xD6E8FEB86659FD93))

    def split_tails(self, tail: np.ndarray, before: np.ndarray) -> None:
        """Make the last byte of a word a unit of its own where it is in tail and follows one in before (tables of 256)."""
        cut = (self.end - self.start >= 2) & tail[self.data[self.end - 1]] & before[self.data[np.maximum(self.end - 2, 0)]]
        at = np.flatnonzero(cut) + 1
        ends = self.end[cut]
        self.first = self.first + np.concatenate([[0], np.cumsum(cut)])[self.first]
        self.start = np.insert(self.start, at, ends - 1)
        body = self.end - cut
        self.end = np.insert(body, at, ends)
        self._hash()

    def texts(self, index: np.ndarray) -> list[str]:
        data = self.data.tobytes()
        return [data[a:b].decode() for a, b in zip(self.start[index].tolist(), self.end[index].tolist())]


def shingles(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the shingle of k words at each place, offsets by text); with short, a text of 1 to k-1 words has one shingle of all its words."""
    h, first = words.hash, words.first
    count = np.diff(first)
    m = np.where(count >= k, count - k + 1, (count > 0) & short).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(m)])
    place = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - first[:-1], m)
    few = np.repeat(np.minimum(count, k), m)
    out = few.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for j in range(k):
        use = few > j if short else slice(None)
        out[use] = mix(out[use] + h[place[use] + j])
    return out, offsets


def unique_sets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and without repeats, and their offsets."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    new[starts] = True
    upto = np.concatenate([[0], np.cumsum(new)])
    return values[new], upto[offsets]
