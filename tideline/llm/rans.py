"""Token ids in files of static range asymmetric numeral systems (rANS), written and read in parallel.

One frequency table, counted over all ids, serves every block; it is written beside the frames with
the parameters of the format, so that the path alone is enough to read. Documents are in ascending
``doc_id`` order. A row of the files is a frame: whole documents, whose ids are cut into independent blocks of
``BLOCK`` ids, each spread over ``LANES`` interleaved states. A block has a checkpoint (all its
states and its place in the word stream) every ``SEGMENT`` rows of lanes, from which decoding can
start, and the CRC-32 of its ids. Encoding and decoding run over all blocks, or all checkpoints, of
a frame at once as array operations.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.storage import materialise, shared_folder
from tideline.llm.textops import tidied
from tideline.llm.tokens import encoder

#: Bits of the frequency scale, ids of a block, interleaved states, rows of lanes between checkpoints.
SCALE, BLOCK, LANES, SEGMENT = 18, 1 << 15, 64, 256
#: Ids of a frame at least (a frame ends with a document), and of a partition of the files on average.
FRAME_IDS, PART_IDS = 1 << 20, 1 << 22
#: Most partitions of the files, which bounds the table of their first ids that readers share.
MAX_PARTS = 100_000
#: The id that ends a document.
END_ID = 1
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to ``1 << SCALE``, and their running starts."""

    freq: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        """Scaled counts; every id that occurs has at least 1."""
        counts = counts.astype(np.float64)
        present = counts > 0
        size = 1 << SCALE
        if np.count_nonzero(present) > size // 2:
            raise ValueError("too many distinct ids for the scale")
        freq = np.where(present, np.maximum(1, np.floor(counts / max(counts.sum(), 1) * size)), 0).astype(np.int64)
        order = np.argsort(-freq, kind="stable")
        excess = int(freq.sum()) - size
        if present.any():
            while excess:  # the commonest ids give or take what is left
                step = np.sign(excess)
                able = order[freq[order] > 1][: abs(excess)] if step > 0 else order[present[order]][: abs(excess)]
                freq[able] -= step
                excess -= step * len(able)
        return Table(freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64))

    @property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())


def encode_blocks(ids: np.ndarray, table: Table) -> list[dict]:
    """Encodes blocks of equal length: ``ids`` has one row per block."""
    blocks, n = ids.shape
    rows = -(-n // LANES)
    padded = np.full((blocks, rows * LANES), ids[0, 0], ids.dtype)
    padded[:, :n] = ids
    lanes = padded.reshape(blocks, rows, LANES)
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.empty((rows, blocks, LANES), np.uint32)
    flags = np.empty((rows, blocks, LANES), bool)
    marks: dict[int, np.ndarray] = {}
    for r in range(rows - 1, -1, -1):
        symbols = lanes[:, r, :]
        freq = table.freq[symbols]
        full = state >= freq << np.uint64(63 - SCALE)
        flags[r], words[r] = full, state
        state = np.where(full, state >> _32, state)
        whole = state // freq
        state = (whole << np.uint64(SCALE)) + (state - whole * freq) + table.start[symbols]
        if r % SEGMENT == 0:
            marks[r] = state
    out = []
    for b in range(blocks):
        own = flags[:, b, :]
        before = np.concatenate([[0], np.cumsum(own.sum(1))])
        at = sorted(marks)
        out.append({
            "n": n, "words": words[:, b, :][own].astype("<u4").tobytes(), "crc": zlib.crc32(ids[b].astype("<u4").tobytes()),
            "marks": [int(before[r]) for r in at], "states": np.concatenate([marks[r][b] for r in at]).astype("<u8").tobytes(),
        })
    return out


def decode_segments(words: np.ndarray, at: np.ndarray, state: np.ndarray, rows: np.ndarray, table: Table, slots: np.ndarray) -> np.ndarray:
    """Ids (segment, row, lane) from checkpoints: ``at`` are places in ``words``, ``state`` is (segment, lane)."""
    most = int(rows.max())
    out = np.zeros((len(rows), most, LANES), np.uint32)
    order = np.argsort(-rows, kind="stable")
    at, state, rows = at[order].copy(), state[order], rows[order]
    words = np.append(words, np.uint32(0))
    mask = np.uint64((1 << SCALE) - 1)
    for r in range(most):
        live = int(np.searchsorted(-rows, -r, "left"))  # segments with more than r rows come first
        state, at = state[:live], at[:live]
        slot = state & mask
        symbols = slots[slot]
        out[order[:live], r] = symbols
        state = table.freq[symbols] * (state >> np.uint64(SCALE)) + slot - table.start[symbols]
        low = state < _LOW
        ahead = np.cumsum(low, axis=1)
        place = np.where(low, np.minimum(at[:, None] + ahead - 1, len(words) - 1), len(words) - 1)
        state = np.where(low, (state << _32) | words[place], state)
        at = at + ahead[:, -1]
    return out


_FRAME = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("frame", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("n_tokens", T.ArrayType(T.LongType())), T.StructField("table_crc", T.LongType()),
    T.StructField("block_ids", T.ArrayType(T.IntegerType())), T.StructField("block_words", T.ArrayType(T.IntegerType())), T.StructField("block_crc", T.ArrayType(T.LongType())),
    T.StructField("marks", T.ArrayType(T.IntegerType())), T.StructField("states", T.BinaryType()), T.StructField("words", T.BinaryType()),
])
_ARROW_FRAME = pa.schema([
    ("part", pa.int32()), ("frame", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())),
    ("table_crc", pa.int64()), ("block_ids", pa.list_(pa.int32())), ("block_words", pa.list_(pa.int32())), ("block_crc", pa.list_(pa.int64())),
    ("marks", pa.list_(pa.int32())), ("states", pa.binary()), ("words", pa.binary()),
])


def write_frame(part: int, frame: int, start: int, docs: list[tuple[int | None, np.ndarray]], table: Table) -> dict:
    """A frame's row from whole documents."""
    ids = np.concatenate([x for _, x in docs]).astype(np.uint32)
    whole = len(ids) // BLOCK
    blocks = encode_blocks(ids[: whole * BLOCK].reshape(whole, BLOCK), table) if whole else []
    if len(ids) % BLOCK:
        blocks += encode_blocks(ids[None, whole * BLOCK :], table)
    return {
        "part": part, "frame": frame, "start": start, "n_ids": len(ids), "doc_ids": [d for d, _ in docs], "n_tokens": [len(x) for _, x in docs], "table_crc": table.crc,
        "block_ids": [b["n"] for b in blocks], "block_words": [len(b["words"]) // 4 for b in blocks], "block_crc": [b["crc"] for b in blocks],
        "marks": [m for b in blocks for m in b["marks"]], "states": b"".join(b["states"] for b in blocks), "words": b"".join(b["words"] for b in blocks),
    }


def read_frame(row: dict, table: Table, slots: np.ndarray) -> np.ndarray:
    """All ids of a frame, decoded from all its checkpoints at once and checked against its checksums."""
    if row["table_crc"] != table.crc:
        raise ValueError("the file was written with another frequency table")
    n = np.array(row["block_ids"], np.int64)
    rows = -(-n // LANES)
    segments = -(-rows // SEGMENT)
    base = np.repeat(np.concatenate([[0], np.cumsum(row["block_words"])[:-1]]), segments)
    block = np.repeat(np.arange(len(n)), segments)
    order = np.arange(len(block)) - np.repeat(np.cumsum(segments) - segments, segments)
    lengths = np.minimum(SEGMENT, rows[block] - order * SEGMENT)
    state = np.frombuffer(row["states"], "<u8").reshape(-1, LANES).astype(np.uint64)
    words = np.frombuffer(row["words"], "<u4")
    decoded = decode_segments(words, base + np.array(row["marks"], np.int64), state, lengths, table, slots)
    out = []
    for b in range(len(n)):
        own = np.flatnonzero(block == b)
        ids = np.concatenate([decoded[s, : lengths[s]].ravel() for s in own])[: n[b]]
        if zlib.crc32(ids.astype("<u4").tobytes()) != row["block_crc"][b]:
            raise ValueError(f"block {b} of frame {row['frame']} of part {row['part']} is damaged")
        out.append(ids)
    return np.concatenate(out)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, h, ids): every text's ids with the end id, written once; ``ids`` are little-endian, of type ``id_type``."""
    kind = id_type(tokenizer)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(tokenizer)
        for batch in batches:
            ids = [np.append(x, end_id).astype(kind).tobytes() for x in library.column(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], names=schema.names)

    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(tidied(encode), schema), "ids")


def id_type(tokenizer: str) -> str:
    """The narrowest type that holds the vocabulary's ids."""
    return "<u2" if encoder(tokenizer).library.get_vocab_size() <= 1 << 16 else "<u4"


def count_ids(ids: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs in ``encoded`` rows, end ids included."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(1, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                more = np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=len(totals))
                more[: len(totals)] += totals
                totals = more
        seen = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(totals[seen])], names=schema.names)

    rows = ids.select("ids").mapInArrow(count, schema).groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)  # as many rows as the vocabulary has ids
    for r in rows:
        counts[r.id] = r.n
    return counts


_FORMAT = T.StructType([
    *[T.StructField(n, T.IntegerType()) for n in ("scale", "block", "lanes", "segment", "end_id")], T.StructField("tokenizer", T.StringType()), T.StructField("freq", T.BinaryType()),
])


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Writes the ids of ``docs(doc_id, text)`` in ascending ``doc_id`` order to ``path``: frames, and the table to read them by.

    A null or empty text is its end id alone. Null ids come first; rows that share an id are in the
    order of their texts' hashes. Extra columns are ignored; an empty table gives a file without frames.
    """
    kind = id_type(tokenizer)
    ids = encoded(docs, tokenizer, end_id)
    counts = count_ids(ids, kind)
    table = Table.of(counts)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    parts = max(1, min(MAX_PARTS, math.ceil(int(counts.sum()) / PART_IDS)))
    # the last key only parts rows that are equal in all that matters
    keyed = ids.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    ranged = keyed.repartitionByRange(parts, "doc_id", "h", "salt").sortWithinPartitions("doc_id", "h").select("doc_id", "ids")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, frame, start, held, docs_now = TaskContext.get().partitionId(), 0, 0, 0, []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([write_frame(part, frame, start, docs_now, shared.value)], schema=_ARROW_FRAME)

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, kind).astype(np.uint32)
                docs_now.append((doc, ids))
                held += len(ids)
                if held >= FRAME_IDS:
                    yield close()
                    frame, start, held, docs_now = frame + 1, start + held, 0, []
        if docs_now:
            yield close()

    ranged.mapInArrow(tidied(frames), _FRAME).write.parquet(f"{path}/frames")
    row = (SCALE, BLOCK, LANES, SEGMENT, end_id, tokenizer.rpartition("/")[2], bytearray(table.freq.astype("<u4").tobytes()))
    docs.sparkSession.createDataFrame([row], _FORMAT).coalesce(1).write.parquet(f"{path}/table")


def read_table(spark: SparkSession, path: str) -> Table:
    """The frequency table of files of ``write_ids``; files of another format are an error."""
    row = spark.read.schema(_FORMAT).parquet(f"{path}/table").first()
    if row is None or (row.scale, row.block, row.lanes, row.segment) != (SCALE, BLOCK, LANES, SEGMENT):
        raise ValueError("the files have another format")
    freq = np.frombuffer(bytes(row.freq), "<u4").astype(np.uint64)
    return Table(freq, np.cumsum(freq) - freq)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from files of ``write_ids``; ``ids`` are little-endian unsigned 32-bit.

    ``start`` counts the ids of all documents before, over all files.
    """
    table = read_table(spark, path)
    frames = spark.read.schema(_FRAME).parquet(f"{path}/frames")
    shared = spark.sparkContext.broadcast(table)
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        slots = np.repeat(np.arange(len(table.freq), dtype=np.uint32), table.freq.astype(np.int64))
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, sizes = read_frame(row, table, slots).astype("<u4"), np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                raw = pa.array([ids[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sizes), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - sizes), pa.array(sizes), raw], names=schema.names)

    # one row per part, MAX_PARTS at most: their running sum
    per_part = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return frames.mapInArrow(decode, schema).join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes ``docs`` to a new place in the shared folder and reads it back: ``read_ids``' columns."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path)
