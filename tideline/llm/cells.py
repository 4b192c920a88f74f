"""How often hashed things occur over all rows, counted in a fixed number of cells.

What executors share is 2 bytes a cell, however large the input: counts on a logarithmic scale.
Things that share a cell share its count, so a count is never too low; as the input grows, rare
things come to look alike. Every task counts into its own cells and sends them in compressed chunks,
which are summed in two steps: no task gets more than about the root of the number of tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells, cells of a chunk, and ranks a doubling of the count.
CELLS, CHUNK, STEPS = 1 << 22, 1 << 16, 64
#: Hashes that a task holds before it adds them to its cells.
_RUN = 1 << 20


def squeezed(columns: list[np.ndarray]) -> bytes:
    """Little-endian integer columns by byte planes, which suits sorted and small values."""
    planes = [c.view(np.uint8).reshape(len(c), -1).T for c in columns]
    return pa.compress(np.concatenate([p.ravel() for p in planes]), codec="zstd", asbytes=True)


def _opened(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 8 * CHUNK, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, CHUNK).T).view(np.int64).ravel()


class Counter:
    """One task's cells."""

    def __init__(self) -> None:
        self.cells, self._run, self._held = np.zeros(CELLS, np.uint32), [], 0

    def add(self, hashes: np.ndarray) -> None:
        self._run.append(hashes)
        self._held += len(hashes)
        if self._held > _RUN:
            self._settle()

    def _settle(self) -> None:
        if self._run:
            at, n = np.unique((np.concatenate(self._run) % np.uint64(CELLS)).astype(np.uint32), return_counts=True)
            self.cells[at] += n.astype(np.uint32)
        self._run, self._held = [], 0

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        """(chunk, counts) of the chunks that are not empty."""
        self._settle()
        for k, part in enumerate(self.cells.reshape(-1, CHUNK)):
            if part.any():
                yield k, squeezed([part.astype(np.int64)])


def _total(rows: pa.Table) -> np.ndarray:
    total = np.zeros(CHUNK, np.int64)
    for raw in rows["counts"].to_pylist():
        total += _opened(raw)
    return total


def ranks(parts: DataFrame) -> np.ndarray:
    """``round down(STEPS * log2(count + 1))`` of every cell from ``parts(chunk, counts)`` of all tasks."""

    def add(rows: pa.Table) -> pa.Table:
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "counts": pa.array([squeezed([_total(rows)])], pa.binary())})

    def rank(rows: pa.Table) -> pa.Table:
        found = (np.log2(_total(rows) + 1) * STEPS).astype(np.uint16)
        return pa.table({"chunk": rows["chunk"].slice(0, 1), "ranks": pa.array([found.tobytes()], pa.binary())})

    salts = math.ceil(math.sqrt(parts.count() / (CELLS // CHUNK) + 1))
    salted = parts.select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(salts)).alias("salt"))
    sums = salted.groupBy("chunk", "salt").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(CELLS, np.uint16)
    for row in sums.groupBy("chunk").applyInArrow(rank, "chunk int, ranks binary").collect():
        out[row.chunk * CHUNK : (row.chunk + 1) * CHUNK] = np.frombuffer(row.ranks, np.uint16)
    return out
