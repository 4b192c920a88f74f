"""Token ids of Arrow text columns, by the ``tokenizers`` library, each distinct chunk encoded once.

The encoders used here never look across a place where white space follows a visible character, so
a text's ids are those of its chunks (a run of white space and the visible run after it) in order.
A worker keeps the ids of the chunks that it has met, keyed by 64-bit hashes, in flat arrays of a
bounded number of entries, and hands only new chunks to the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from tideline.llm.textops import distinct, short_hashes, slices

#: Chunks whose ids a worker keeps at most (about 35 bytes each); later ones are encoded anew.
KEPT_CHUNKS = 1_500_000
#: Chunks handed to the library at once, which bounds what its results take.
AT_ONCE = 1024
#: Chunks that are handed over as one text where that changes no id, and their bytes at most: the library's cost is by text.
TOGETHER, TOGETHER_BYTES = 64, 256


def _visible(data: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether the byte before each of the places ``before`` ends a character that is surely visible; see ``_chunk_starts``."""
    last, prior = data[before - 1], data[np.maximum(before - 2, 0)]
    return ((last > 0x20) & (last < 0x7F)) | ((before > 1) & (last >= 0x80) & (last < 0xC0) & (prior >= 0xC3) & (prior < 0xE0))


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_MARK[list(b".,;:!?")] = True


def _chunk_starts(data: np.ndarray, offsets: np.ndarray, marks: bool = False) -> np.ndarray:
    """Where chunks start: at documents, at a space or line feed after a visible character, and with ``marks`` at one after a letter.

    Only characters that are surely visible count: ASCII ones and those of two UTF-8 bytes from
    U+00C0 on; elsewhere the chunk goes on, which is slower but gives the same ids.
    """
    n = len(data)
    at = np.zeros(n + 1, bool)
    if n > 1:
        before = data[:-1]
        seen = (before > 0x20) & (before < 0x7F)
        wide = np.zeros(n - 1, bool)
        wide[1:] = (before[1:] >= 0x80) & (before[1:] < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
        at[1:n] = ((data[1:] == 0x20) | (data[1:] == 0x0A)) & (seen | wide)
        if marks:
            at[1:n] |= _LETTER[before] & _MARK[data[1:]]
    at[offsets] = True
    at[n] = False
    return np.flatnonzero(at)


def _byte_lengths(library: object) -> np.ndarray | None:
    """How many bytes of text each token stands for, by id; None unless the model is BPE over bytes as they are, in words that end where letters do."""
    kinds = [type(x).__name__ for x in (library.model, library.pre_tokenizer, library.decoder)]
    if kinds != ["BPE", "ByteLevel", "ByteLevel"] or library.normalizer is not None or library.pre_tokenizer.add_prefix_space or not library.pre_tokenizer.use_regex:
        return None
    vocabulary = library.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
    lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]  # one character for each byte
    return lengths


class Encoder:
    """Encodes slices of text; see the module. ``path`` is a file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        #: Where a token stands for its bytes as they are, the number of these, by id.
        self.lengths = _byte_lengths(self.library)
        # sorted runs of (keys, first, count), each at least twice the next, so that adding is cheap
        self._runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._kept = 0
        self._ids = np.empty(1 << 16, np.uint32)
        self._used = 0

    def _add(self, run: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        self._kept += len(run[0])
        while self._runs and len(self._runs[-1][0]) < 2 * len(run[0]):
            both = [np.concatenate(x) for x in zip(self._runs.pop(), run, strict=True)]
            order = np.argsort(both[0], kind="stable")
            run = tuple(x[order] for x in both)
        self._runs.append(run)

    def _lists(self, texts: list[str], at_once: int) -> Iterator[list[int]]:
        for k in range(0, len(texts), at_once):
            yield from [e.ids for e in self.library.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False)]

    def _alone(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and all ids in order."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        encoded = list(self._lists(texts, AT_ONCE))
        return np.fromiter(map(len, encoded), np.int64, len(encoded)), np.fromiter(chain.from_iterable(encoded), np.uint32)

    def _together(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """The same with many chunks in one text, told apart by their tokens' bytes; None where a token is not within a chunk."""
        size = ends - starts
        bounds = np.cumsum(size)
        raw = data[np.repeat(starts - (bounds - size), size) + np.arange(bounds[-1])].tobytes()
        cuts = [0, *bounds[TOGETHER - 1 : -1 : TOGETHER].tolist(), len(raw)]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        flat = np.fromiter(chain.from_iterable(self._lists(texts, AT_ONCE // TOGETHER)), np.uint32)
        reached = np.cumsum(self.lengths[flat])
        last = np.searchsorted(reached, bounds)
        if not len(reached) or reached[-1] != len(raw) or not np.array_equal(reached[last], bounds):
            return None
        return np.diff(np.append(-1, last)), flat

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the chunks, how many ids each has in this order, and all ids in this order."""
        near = np.zeros(len(starts), bool)
        if self.lengths is not None:  # white space after a visible character parts them, as in a text
            near = ((data[starts] == 0x20) | (data[starts] == 0x0A)) & (ends - starts <= TOGETHER_BYTES) & _visible(data, ends)
        some, rest = np.flatnonzero(near), np.flatnonzero(~near)
        found = self._together(data, starts[some], ends[some]) if len(some) else None
        if found is None:
            return np.arange(len(starts)), *self._alone(data, starts, ends)
        counts, flat = (np.concatenate(x) for x in zip(found, self._alone(data, starts[rest], ends[rest]), strict=True))
        return np.concatenate([some, rest]), counts, flat

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(chunk starts, index of each chunk's distinct chunk, first and count of its ids, all ids)."""
        starts = _chunk_starts(data, offsets, self.lengths is not None)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        keys_here, at, inverse = distinct(short_hashes(data, starts, ends))
        first, count = np.full(len(keys_here), -1, np.int64), np.zeros(len(keys_here), np.int64)
        for keys, firsts, counts in self._runs:
            left = np.flatnonzero(first < 0)
            place = np.minimum(np.searchsorted(keys, keys_here[left]), len(keys) - 1)
            hit = keys[place] == keys_here[left]
            first[left[hit]], count[left[hit]] = firsts[place[hit]], counts[place[hit]]
        new = np.flatnonzero(first < 0)
        if len(new):
            order, counts, flat = self._encode(data, starts[at[new]], ends[at[new]])
            if self._used + len(flat) > len(self._ids):
                self._ids = np.concatenate([self._ids[: self._used], np.empty(max(len(self._ids), len(flat)), np.uint32)])
            self._ids[self._used : self._used + len(flat)] = flat
            first[new[order]] = self._used + np.cumsum(counts) - counts
            count[new[order]] = counts
            if self._kept + len(new) <= KEPT_CHUNKS and self._used + len(flat) < 1 << 32:
                self._add((keys_here[new], first[new].astype(np.uint32), count[new].astype(np.uint32)))
                self._used += len(flat)
        return starts, inverse, first, count, self._ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice, and the bounds of its documents in them."""
        starts, inverse, first, count, ids = self.chunks(data, offsets)
        size = count[inverse]
        ends = np.cumsum(size)
        flat = ids[np.repeat(first[inverse] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        total = np.concatenate([[0], ends])
        return flat, total[np.searchsorted(starts, offsets)]

    def column(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each row; a null row has none."""
        for _, data, offsets in slices(column):
            flat, bounds = self.encode(data, offsets)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                yield flat[a:b]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
