"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``points`` points of a 64-bit ring; a key belongs to the first point clockwise of
its hash. Shards have capacities that differ by at most one row and add up to all rows. Keys that
overflow a full shard continue clockwise to the next shard with room, so that counts are balanced
exactly and few keys move when the number of shards changes.

The load bound is settled on counts per arc (there are ``shards * points + 1`` arcs, whatever the
data's size): arcs offer their keys to their own shard first, then to the next shards clockwise, in
ring order, and a shard that fills up takes an arc's first keys by ring position. Rows then find
their piece of the arc by rank, and ranks come from cells of an arc that are small enough for one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.storage import materialise

#: Points of each shard on the ring.
POINTS = 128
#: Rows that a cell of an arc holds on average at most.
CELL_ROWS = 20_000
#: Rows that one step of an expansion of repeated rows makes.
_CHUNK = 100_000


def ring(shards: int, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (unsigned, ascending) of all points, and their shards."""
    at = [(int.from_bytes(hashlib.blake2b(f"{s}/{p}".encode(), digest_size=8).digest(), "big"), s) for s in range(shards) for p in range(points)]
    at.sort()
    return np.array([x for x, _ in at], np.uint64), np.array([s for _, s in at], np.int64)


def bounded_loads(counts: dict[int, int], owners: np.ndarray, shards: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (arc, first rank, last rank + 1, shard, first slot) for keys counted per arc.

    Arc ``i`` ends at point ``i``; the arc after the last point belongs to the first point.
    """
    total, n = sum(counts.values()), len(owners)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, pieces = [0] * shards, []
    left = {arc: (0, c) for arc, c in sorted(counts.items()) if c}
    walks = {}
    for arc in left:
        seen = dict.fromkeys(int(owners[(arc + k) % n]) for k in range(n))
        walks[arc] = list(seen)
    for hop in range(shards):
        for arc in list(left):
            at, end = left[arc]
            shard = walks[arc][hop]
            take = min(end - at, room[shard] - used[shard])
            if take:
                pieces.append((arc, at, at + take, shard, used[shard]))
                used[shard] += take
                left[arc] = (at + take, end)
            if left[arc][0] == end:
                del left[arc]
    return pieces


def _expanded(df: DataFrame, count: str, index: str) -> DataFrame:
    """``count`` copies of each row, numbered from 0 in ``index``, made in bounded chunks."""
    steps = df.withColumn("__step", F.explode(F.sequence(F.lit(0), ((F.col(count) - 1) / _CHUNK).cast("long"))))
    within = F.least(F.lit(_CHUNK), F.col(count) - F.col("__step") * _CHUNK)
    rows = steps.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), within - 1)))
    return rows.withColumn(index, F.col("__step") * _CHUNK + F.col("__i")).drop("__step", "__i")


def assign_shards(docs: DataFrame, shards: int = 16, points: int = POINTS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs(doc_id, text)``.

    ``size`` is the text's UTF-8 bytes plus 1; slots are gapless from 0 in each shard, and the
    shards' row counts differ by at most one. A null or empty text has size 1 and crc 0; a null
    ``doc_id`` is a key like any other. Rows equal in id and text are counted before they are
    shuffled and then get ranks side by side. Extra columns are ignored. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    keyed = slim.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")).withColumn("pos", F.xxhash64("doc_id", "text_crc32", "size"))
    at, owners = ring(shards, points)
    placed_schema = T.StructType([*keyed.schema.fields, T.StructField("arc", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(at, pos).astype(np.int64))], names=placed_schema.names)

    placed = materialise(keyed.mapInArrow(place, placed_schema), "ring")
    per_arc = {r.arc: r.n for r in placed.groupBy("arc").agg(F.sum("copies").alias("n")).collect()}
    pieces = bounded_loads(per_arc, owners, shards)
    # Cells: equal ranges of the ring, cut where arcs end; more of them as rows grow.
    bits = max(0, min(40, math.ceil(math.log2(max(1.0, sum(per_arc.values()) / cell_rows)))))
    cell = F.shiftrightunsigned(F.col("pos"), 64 - bits) if bits else F.lit(0).cast("long")
    placed = placed.withColumn("cell", cell)
    cells = placed.groupBy("arc", "cell").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("arc", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # unsigned order of positions within a cell: all but cell 0 of no bits share their sign
    clockwise = Window.partitionBy("arc", "cell").orderBy(F.col("pos") < 0, "pos", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("start", F.coalesce(F.sum("copies").over(clockwise), F.lit(0))).join(cells, ["arc", "cell"])
    single = ranked.where("copies = 1").withColumn("i", F.lit(0).cast("long"))
    rows = single.unionByName(_expanded(ranked.where("copies > 1"), "copies", "i")).withColumn("rank", F.col("base") + F.col("start") + F.col("i"))
    spark = docs.sparkSession
    table = spark.createDataFrame(pieces, "arc long, first long, last long, shard int, slot0 long")
    found = rows.join(F.broadcast(table), "arc").where("rank >= first and rank < last")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
