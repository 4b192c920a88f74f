"""Lexical retrieval packing: windows filled with a seed document's nearest unused neighbours.

Document frequencies (in cells of a fixed number, see ``cells``), the number of documents and their
mean length are counted over all documents. Documents are ordered by a lexical code, their path down
a tree of centres of BM25 vectors and then a min-hash of their terms weighted by IDF, and runs of
this order are shards of a bounded number of bytes: documents that share telling terms meet, and
groups that are too large for a shard are split. A shard holds a BM25 inverted index over its own
documents, weighted by the frequencies in all. Some windows are filled at once, each greedily: the
document that opens a window is its seed; its best-scoring unused neighbours follow until the window
is full; the document that crosses into the next window is cut there and is that window's seed. Only
a shard's last window can need padding.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.cells import CELLS, STEPS, Counter, ranks
from tideline.llm.storage import materialise
from tideline.llm.textops import Words, give_back, mix, short_hashes, slices, tidied
from tideline.llm.tokens import encoder

#: Tokens of a window, the id that ends a document, and text bytes of a shard at most (a longer document is one alone).
WINDOW, END_ID, SHARD_BYTES = 1024, 0, 4 << 20
#: Text bytes of a partition of the ordered documents, on average: each ends with a shard that may be smaller.
PART_BYTES = 32 << 20
#: BM25's constants, how many of a seed's neighbours are put in order at first, and windows filled at once:
#: one for so many documents of the shard, up to a number.
K1, B, NEAREST, PER_WINDOW, ABREAST = 1.2, 0.75, 64, 64, 16
#: Slots of a document's vector, branches and levels of the tree of centres (4 bits of a code each), and
#: documents that it is trained on, in expectation.
SLOTS, BRANCHES, LEVELS, TRAINED = 256, 16, 6, 8192
#: Bits of a term's hash, and of a code's min-hash and tail; the tail tells equal documents apart.
TERM_BITS, MIN_BITS, TAIL_BITS = 44, 12, 28

_PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])
_ARROW_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def postings(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice its first row, (document, term, frequency) by document and term, and documents' lengths."""
    low = np.uint64((1 << TERM_BITS) - 1)
    for row, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        # a slice has at most 2**20 rows, so that a document and a term are one number
        key = words.doc.astype(np.uint64) << np.uint64(TERM_BITS) | short_hashes(words.data, words.starts, words.ends) >> np.uint64(64 - TERM_BITS)
        key.sort()
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        yield row, (key[at] >> np.uint64(TERM_BITS)).astype(np.int64), key[at] & low, np.diff(np.append(at, len(key))), words.counts


@dataclass(frozen=True)
class Corpus:
    """Counts over all documents; ``ranks`` are those of the terms' cells."""

    n: int
    words: int
    size: int
    ranks: np.ndarray

    @staticmethod
    def count(docs: DataFrame) -> Corpus:
        """From ``docs(text)``, in one pass; only cells of a fixed number are shuffled."""

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, n, words, size = Counter(), 0, 0, 0
            for batch in batches:
                n += batch.num_rows
                size += 64 * batch.num_rows
                for _, _, term, tf, _ in postings(batch.column(0)):
                    cells.add(term)
                    words += int(tf.sum())
                size += sum(len(data) for _, data, _ in slices(batch.column(0)))
            rows = [{"chunk": k, "counts": counts} for k, counts in cells.chunks()] + [{"n": n, "words": words, "size": size}]
            kinds = [("chunk", pa.int32()), ("counts", pa.binary()), ("n", pa.int64()), ("words", pa.int64()), ("size", pa.int64())]
            for row in rows:
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))

        parts = materialise(docs.select("text").mapInArrow(tidied(partial), "chunk int, counts binary, n bigint, words bigint, size bigint"), "terms")
        n, words, size = (x or 0 for x in parts.agg(F.sum("n"), F.sum("words"), F.sum("size")).first())
        return Corpus(n, words, size, ranks(parts.where("chunk is not null")))

    def frequency(self, terms: np.ndarray) -> np.ndarray:
        """In about how many documents each term is: its cell's count."""
        found = np.exp2((self.ranks[(terms % np.uint64(CELLS)).astype(np.int64)] + 0.5) / STEPS) - 1
        return np.maximum(found, 1)

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(self.n - df + 0.5, 0.5) / (df + 0.5))

    def weigh(self, df: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """BM25's weights of terms in documents of a ``length``."""
        return self.idf(df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.words / max(self.n, 1), 1e-9)))


def vectors(column: pa.Array, corpus: Corpus) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice its first row, unit vectors of BM25 weights with terms hashed to ``SLOTS``, and each
    document's min-hash: equal for two documents as often as their terms are common, by IDF."""
    for row, doc, term, tf, lengths in postings(column):
        df = corpus.frequency(term)
        mixed = mix(term)
        weight = corpus.weigh(df, tf, lengths[doc]) * np.where(mixed >> np.uint64(63), 1, -1)
        slot = doc * SLOTS + (mixed & np.uint64(SLOTS - 1)).astype(np.int64)
        dense = np.bincount(slot, weight, len(lengths) * SLOTS).reshape(-1, SLOTS)
        least = np.zeros(len(lengths), np.uint64)
        if len(doc):
            draw = -np.log(((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / np.maximum(corpus.idf(df), 1e-9)
            first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
            lowest = np.repeat(np.minimum.reduceat(draw, first), np.diff(np.append(first, len(doc))))
            at = np.flatnonzero(draw == lowest)
            least[doc[at]] = mix(mixed[at]) >> np.uint64(64 - MIN_BITS)
        yield row, (dense / np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)).astype(np.float32), least


@dataclass(frozen=True)
class Centres:
    """A node of the tree: unit centres and, for each, the node below it or None."""

    centres: np.ndarray
    below: list[Centres | None]

    @staticmethod
    def grow(x: np.ndarray, shards: float, level: int = 0) -> Centres | None:
        """Splits ``x``, which stand for so many shards' documents, by spherical k-means, until half a shard is left."""
        k = min(BRANCHES, math.ceil(2 * shards), len(x) // 4)
        if k < 2 or level == LEVELS:
            return None
        centres, near = x[:1], x @ x[0]
        while len(centres) < k and near.min() < 1 - 1e-5:  # the farthest ones first, so that copies open one branch
            centres = np.concatenate([centres, x[[near.argmin()]]])
            near = np.maximum(near, x @ centres[-1])
        for _ in range(8):
            mine = (x @ centres.T).argmax(1)
            sums = np.stack([x[mine == i].sum(0) for i in range(len(centres))])
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centres).astype(np.float32)
        mine = (x @ centres.T).argmax(1)
        if len(np.unique(mine)) < 2:
            return None
        return Centres(centres, [Centres.grow(x[mine == i], shards * (mine == i).mean(), level + 1) for i in range(len(centres))])

    @staticmethod
    def learn(docs: DataFrame, corpus: Corpus, shared: Broadcast, shards: float) -> Centres | None:
        """From ``TRAINED`` of ``docs(text, tail)`` in expectation, by the hash ``tail``; they decide company only, not what is packed."""
        if shards <= 1:
            return None
        chance = min(TRAINED / corpus.n, 1)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, x, _ in vectors(batch.column(0), shared.value):
                    yield pa.RecordBatch.from_arrays([pa.array([v.astype("<f4").tobytes() for v in x], pa.binary())], names=["x"])

        chosen = docs.where(F.pmod("tail", F.lit(1 << 40)) < int(chance * (1 << 40)))
        rows = sorted(r.x for r in chosen.select("text").mapInArrow(encode, "x binary").toLocalIterator())
        return Centres.grow(np.frombuffer(b"".join(rows), "<f4").reshape(-1, SLOTS), shards) if rows else None

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Paths down the tree, 4 bits a level from the first bit of 64 on."""
        out, left = np.zeros(len(x), np.uint64), [(self, np.arange(len(x)), 60)]
        while left:
            node, rows, shift = left.pop()
            mine = (x[rows] @ node.centres.T).argmax(1)
            out[rows] |= mine.astype(np.uint64) << np.uint64(shift)
            left += [(below, part, shift - 4) for i, below in enumerate(node.below) if below and len(part := rows[mine == i])]
        return out


def codes(column: pa.Array, corpus: Corpus, tree: Centres | None) -> np.ndarray:
    """Each document's lexical code without its tail: its path down the tree and its min-hash."""
    out = np.zeros(len(column), np.uint64)
    for row, x, least in vectors(column, corpus):
        out[row : row + len(x)] = least << np.uint64(TAIL_BITS)
        if tree:
            out[row : row + len(x)] |= tree.paths(x)
    return out


def by_term(term: np.ndarray) -> np.ndarray:
    """The stable order of terms, by a plain sort of numbers that end with their places where these fit."""
    bits = np.uint64(64 - TERM_BITS)
    if len(term) > 1 << int(bits):
        return np.argsort(term, kind="stable")
    key = term.astype(np.uint64) << bits | np.arange(len(term), dtype=np.uint64)
    key.sort()
    return (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class BM25:
    """An inverted index over the words (A-Z lower-cased) of one shard's texts, weighted by ``corpus``."""

    def __init__(self, column: pa.Array, corpus: Corpus):
        docs, terms, freqs, lengths = [], [], [], []
        for row, doc, term, tf, counts in postings(column):
            docs.append(doc + row), terms.append(term), freqs.append(tf), lengths.append(counts)
        doc, term, tf = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (docs, terms, freqs))
        length = np.concatenate(lengths).astype(np.float64) if lengths else np.empty(0)
        self.n = n = len(column)
        order = by_term(term)
        first = np.flatnonzero(np.append(True, term[order][1:] != term[order][:-1])[: len(order)])
        self.start = np.append(first, len(order))
        df = np.diff(self.start)
        self.docs = doc[order]
        self.weights = corpus.weigh(np.repeat(corpus.frequency(term[order[first]]), df), tf[order], length[self.docs])
        # each document's terms that other documents share
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(np.arange(len(first)), df)
        shared = np.flatnonzero(df[number] > 1)
        self.first = np.searchsorted(doc[shared], np.arange(n + 1))
        self.query = number[shared]

    def neighbours(self, seeds: list[int], used: np.ndarray) -> list[Iterator[int]]:
        """For each seed every unused document that shares a term with it, best BM25 of all its terms first, ties to the first."""
        terms = [self.query[self.first[s] : self.first[s + 1]] for s in seeds]
        asked = np.concatenate(terms)
        count = self.start[asked + 1] - self.start[asked]
        place = np.repeat(self.start[asked] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        line = np.repeat(np.repeat(np.arange(len(seeds)), [len(t) for t in terms]) * self.n, count)
        scores = np.bincount(self.docs[place] + line, self.weights[place], self.n * len(seeds)).reshape(len(seeds), self.n)
        scores[:, used] = 0
        return [self._best(score) for score in scores]

    @staticmethod
    def _best(score: np.ndarray) -> Iterator[int]:
        found = np.flatnonzero(score)
        score = score[found]
        top = np.ones(len(found), bool)
        if len(found) > NEAREST:
            top = score >= np.partition(score, len(found) - NEAREST)[len(found) - NEAREST]
        for some in (top, ~top):
            yield from found[some][np.argsort(-score[some], kind="stable")].tolist()

    def forget(self, used: np.ndarray) -> None:
        """Drops used documents from the lists that are looked up."""
        keep = ~used[self.docs]
        self.start = np.concatenate([[0], np.cumsum(keep)])[self.start]
        self.docs, self.weights = self.docs[keep], self.weights[keep]


def layout(index: BM25, tokens: np.ndarray, window: int = WINDOW, abreast: int | None = None) -> list[list[int]]:
    """The documents of each of ``abreast`` streams in their order.

    The streams' open windows are filled in turn, each with the best neighbours that are still unused.
    Where no unused document shares a term with the seed, the first unused one follows, as a new seed.
    """
    streams = abreast or min(ABREAST, max(1, index.n // PER_WINDOW))
    orders: list[list[int]] = [[] for _ in range(streams)]
    seeds: list[int | None] = [None] * streams
    used, at, turn, left, kept = np.zeros(index.n, bool), [0] * streams, 0, index.n, index.n

    def put(stream: int, doc: int) -> None:
        used[doc] = True
        orders[stream].append(doc)
        at[stream] += int(tokens[doc])

    while left:
        for s in range(streams):
            while left and seeds[s] is None:
                while used[turn]:
                    turn += 1
                put(s, turn)
                left -= 1
                seeds[s] = turn if at[s] % window else None
        if left < 0.75 * kept:
            index.forget(used)
            kept = left
        waiting = [s for s in range(streams) if seeds[s] is not None] if left else []
        for s, nearest in zip(waiting, index.neighbours([seeds[s] for s in waiting], used) if waiting else [], strict=True):
            room, seeds[s] = -at[s] % window, None
            for near in nearest:
                if used[near]:  # by another window meanwhile
                    continue
                put(s, near)
                left -= 1
                room -= int(tokens[near])
                if room < 0:
                    seeds[s] = near
                if room <= 0:
                    break
    return orders


def _cut(spans: list[tuple[int, int, int]], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, window, offset) of spans (document, start, length) laid end to end."""
    at = 0
    for doc, start, length in spans:
        while length:
            take = min(length, window - at % window)
            yield doc, start, take, at // window, at % window
            start, length, at = start + take, length - take, at + take


def sequences(orders: list[list[int]], tokens: np.ndarray, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """The pieces of all streams; what streams hold beyond their last whole windows is laid end to end."""
    rest, base = [], 0
    for order in orders:
        whole = int(tokens[order].sum()) // window
        for doc, start, length, number, offset in _cut([(d, 0, int(tokens[d])) for d in order], window):
            if number < whole:
                yield doc, start, length, base + number, offset
            else:
                rest.append((doc, start, length))
        base += whole
    for doc, start, length, number, offset in _cut(rest, window):
        yield doc, start, length, base + number, offset


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Runs of the rows of ``batches(.., .., size)`` whose sizes add up to ``most`` at most; a larger row is one alone."""
    held, room = [], most
    for batch in batches:
        total = np.cumsum(batch.column(2).to_numpy())
        row = 0
        while row < batch.num_rows:
            before = int(total[row - 1]) if row else 0
            last = int(np.searchsorted(total, before + room, "right"))
            if last == row and not held:
                last = row + 1
            if last > row:
                held.append(batch.slice(row, last - row))
                room -= int(total[last - 1]) - before
            if last < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, room = [], most
            row = last
    if held:
        yield pa.Table.from_batches(held)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset), one row per piece.

    ``ids`` are little-endian unsigned 32-bit ids. Every row of ``docs(doc_id, text)`` is packed once:
    repeated rows are packed as often as they are there, and spread over shards where they are many. A
    null or empty text is its end id alone, a null ``doc_id`` is carried. Long texts are cut at
    windows. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    corpus = Corpus.count(texts)
    shared = spark.sparkContext.broadcast(corpus)
    texts = texts.withColumns({"tail": F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), "size": (F.octet_length("text") + 64).cast("long")})
    tree = spark.sparkContext.broadcast(Centres.learn(texts, corpus, shared, corpus.size / shard_bytes))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tail = batch.column(2).to_numpy().view(np.uint64) >> np.uint64(64 - TAIL_BITS)
            # flipped so that signed order is that of the codes
            found = (codes(batch.column(1), shared.value, tree.value) | tail).view(np.int64) ^ np.int64(-1 << 63)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(found)], names=["doc_id", "text", "size", "code"])

    coded = materialise(texts.mapInArrow(tidied(code), "doc_id bigint, text string, size bigint, code bigint"), "packing")
    parts = max(1, math.ceil(corpus.size / part_bytes))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for table in shards(batches, shard_bytes):
            table = table.take(pa.array(np.argsort(table["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(), kind="stable")))
            texts, doc_ids = table["text"].combine_chunks(), table["doc_id"].to_pylist()
            ids = [np.append(x, np.uint32(end_id)) for x in encoder(tokenizer).column(texts)]
            tokens = np.array([len(x) for x in ids], np.int64)
            rows: dict[str, list] = {n: [] for n in _PIECES.names}
            last = -1
            for d, start, length, number, offset in sequences(layout(BM25(texts, shared.value), tokens, window), tokens, window):
                values = (doc_ids[d], start, length, ids[d][start : start + length].astype("<u4").tobytes(), int(tokens[d]), base + number, offset)
                for name, value in zip(_PIECES.names, values, strict=True):
                    rows[name].append(value)
                last = number
            base += last + 1
            yield pa.RecordBatch.from_pydict(rows, schema=_ARROW_PIECES)
            del table, texts, ids, rows
            give_back()

    ordered = coded.select("doc_id", "text", "size", "code").repartitionByRange(parts, "code").sortWithinPartitions("code")
    return ordered.select("doc_id", "text", "size").mapInArrow(fill, _PIECES)
