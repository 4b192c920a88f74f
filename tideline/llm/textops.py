"""Vectorised text primitives shared by the operators: words, hashes and shingles of Arrow batches.

Everything here works on the UTF-8 bytes of a slice of an Arrow string column, so that a task
pays NumPy costs per byte, not Python costs per word.  A *word* is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once; a longer single document is a slice alone.
SLICE_BYTES = 1 << 19
#: Rows of a slice at most.
SLICE_ROWS = 1 << 20

_IS_WORD = np.ones(256, np.uint8)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_AS_IS = np.arange(256, dtype=np.uint8)
_LOWER = _AS_IS.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 8 + 5
_BASE_INV = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(int(_rng.integers(1, 2**62)) * 8 + 3)


#: Bytes of a span that is hashed by eights at most, and masks of the first bytes of eight.
SHORT = 64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class _Powers:
    """Powers of an odd base modulo 2**64, grown to the longest slice seen by this worker."""

    def __init__(self, base: int):
        self.base, self.values = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            more = np.uint64(pow(self.base, len(self.values), 1 << 64))
            self.values = np.concatenate([self.values, self.values * more])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INV)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), so that low bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cuts a string column into runs of rows of about ``limit`` bytes.

    Yields (first row, bytes, offsets) with offsets starting at 0; a null row has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        last = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        last = min(max(last, row + 1), n, row + SLICE_ROWS)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def give_back() -> None:
    """Returns freed memory to the system; a worker that waits for its next task would else keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def tidied(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` for ``mapInArrow``, which gives its freed memory back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


class Words:
    """The words of a slice: byte bounds, their document's index and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data, self.offsets = (_LOWER[data] if lower else data), offsets
        n = len(data)
        inside = _IS_WORD[data].view(bool)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(n, bool)
        if n:
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Bounds of each document in the list of words.
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``width`` words within a document, and their first words' indices."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        rolled = hashes[:n].copy()
        for k in range(1, width):
            rolled = rolled * _STEP + hashes[k : k + n]
        first = np.flatnonzero(self.doc[:n] == self.doc[width - 1 : width - 1 + n])
        return mix(rolled[first]), first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes give equal hashes, wherever the span lies."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _UP.upto(len(data)), out=total[1:])
    span = (total[ends] - total[starts]) * _DOWN.upto(len(data) + 1)[starts]
    return mix(span + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def short_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Other hashes of the same kind, by eight bytes at once: faster for spans of a word's length; long ones are left to ``span_hashes``."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded.data, strides=(1,))
    size = ends - starts
    out = eight[starts] & _FIRST[np.minimum(size, 8)]
    at = np.flatnonzero((size > 8) & (size <= SHORT))
    out = mix(out * _STEP + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for k in range(8, SHORT, 8):
        if not len(at):
            break
        more = eight[starts[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]
        out[at] = mix(out[at] * _STEP + more)
        at = at[size[at] > k + 8]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        out[long] = span_hashes(data, starts[long], ends[long])
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` with one index and the inverse, by a plain sort of numbers that end with their places, which is far faster."""
    n = len(hashes)
    bits = np.uint64(max(n - 1, 0).bit_length())
    key = hashes >> bits << bits | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    found = hashes[order]
    new = np.append(True, found[1:] != found[:-1])[:n]
    if (new[1:] & (key[1:] >> bits == key[:-1] >> bits)).any():  # hashes that differ in their last bits alone
        return np.unique(hashes, return_index=True, return_inverse=True)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.cumsum(new) - 1
    return found[new], order[new], inverse


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    A text of fewer words is one shingle of all its words; one without words gives an empty set.
    """
    for _, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        hashes = words.hashes()
        rolled, first = words.windows(hashes, width)
        cut = np.searchsorted(words.doc[first], np.arange(len(offsets)))
        for i, count in enumerate(words.counts):
            if count >= width:
                yield np.unique(rolled[cut[i] : cut[i + 1]])
            elif count:
                short = hashes[words.bounds[i] : words.bounds[i + 1]]
                value = np.uint64(count)
                with np.errstate(over="ignore"):
                    for h in short:
                        value = value * _STEP + h
                yield mix(np.array([value], np.uint64))
            else:
                yield np.empty(0, np.uint64)
