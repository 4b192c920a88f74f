"""Vectors compressed to codes: product quantisation with Hamerly's bounds, in exact integers.

A vector's components become integers ``floor(4096 * c)``, cut into ``PARTS`` equal parts; each part position
has a codebook of up to ``ENTRIES`` entries, trained by Lloyd's rounds. Between rounds each row keeps, by part,
its entry, one upper bound of the distance to it and one lower bound of the distance to every other
entry. When entries move, bounds move by how far they moved. A part keeps its entry without a look at
the others while its upper bound is strictly below the lower one (or half the way from its entry to the
next one); else the upper bound is made exact, and only if that fails too are all entries scanned in
integers, ties to the lower index. Bounds are doubles rounded outwards, so no skipped scan could have
changed or tied an assignment.

What the driver holds is the codebooks; rows pass from round to round through the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import discard, materialise
from tideline.llm.textops import tidied
from tideline.llm.vectors import integer_vectors, listed, matrix, width

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Scaled components lie below this magnitude, so that squared distances and sums of 2^36 rows fit 64 bits.
MOST = 1 << 27

_STATE = "code array<tinyint>, upper array<double>, lower array<double>"


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x, -np.inf), 0.0)


@dataclass(frozen=True)
class Codebooks:
    """``entries``: (parts, entries, width of a part) integers; ``moved``: how far each entry moved in the last round, at most."""

    entries: np.ndarray
    moved: np.ndarray

    @staticmethod
    def first(entries: np.ndarray) -> Codebooks:
        return Codebooks(entries, np.zeros(entries.shape[:2]))

    def after(self, entries: np.ndarray) -> Codebooks:
        gap = entries - self.entries
        return Codebooks(entries, np.where((gap == 0).all(2), 0.0, _up(_up(np.sqrt((gap * gap).sum(2).astype(float))))))

    def half_gaps(self) -> np.ndarray:
        """Half the distance from each entry to the next one of its codebook, at least that."""
        gap = self.entries[:, :, None, :] - self.entries[:, None, :, :]
        squared = (gap * gap).sum(3).astype(float)
        squared[:, np.arange(squared.shape[1]), np.arange(squared.shape[1])] = np.inf
        return _down(_down(np.sqrt(squared.min(2)))) / 2

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of one part the nearest entry, a bound above its distance, and one below all others'."""
    gap = x[:, None, :] - entries
    squared = np.einsum("ned,ned->ne", gap, gap)
    code = squared.argmin(1)  # the first of equal ones
    best = squared[np.arange(len(x)), code]
    squared[np.arange(len(x)), code] = np.iinfo(np.int64).max
    others = squared.min(1) if squared.shape[1] > 1 else best
    lower = np.full(len(x), np.inf) if squared.shape[1] == 1 else _down(_down(np.sqrt(others.astype(float))))
    return code, _up(_up(np.sqrt(best.astype(float)))), lower


def reassign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: Codebooks) -> int:
    """Moves the bounds as the entries moved, and entries where bounds fail, in place; the number of full scans.

    ``x`` is (rows, parts, width); all others are (rows, parts).
    """
    scans, half = 0, books.half_gaps()
    for p in range(x.shape[1]):
        moved = books.moved[p]
        most = moved.argmax()
        second = np.delete(moved, most).max(initial=0.0)
        own = code[:, p].astype(np.int64)
        upper[:, p] = np.where(moved[own] > 0, _up(upper[:, p] + moved[own]), upper[:, p])
        away = np.where(own == most, second, moved[most])
        lower[:, p] = np.where(away > 0, _down(lower[:, p] - away), lower[:, p])
        sure = np.maximum(lower[:, p], half[p][own])
        loose = np.flatnonzero(~(upper[:, p] < sure))
        gap = x[loose, p] - books.entries[p][own[loose]]
        upper[loose, p] = _up(_up(np.sqrt((gap * gap).sum(1).astype(float))))
        loose = loose[~(upper[loose, p] < sure[loose])]
        if len(loose):
            code[loose, p], upper[loose, p], lower[loose, p] = scan(x[loose, p], books.entries[p])
            scans += len(loose)
    return scans


def _assigned(rows: DataFrame, books: Codebooks, fresh: bool) -> DataFrame:
    """``rows`` with their state after one assignment; ``fresh`` rows have none yet."""
    parts, _, part = books.entries.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["x"], parts * part).reshape(-1, parts, part)
            if fresh:
                found = [scan(x[:, p], books.entries[p]) for p in range(parts)]
                code, upper, lower = (np.stack([f[k] for f in found], 1) for k in range(3))
            else:
                code, upper, lower = (matrix(batch[c], parts, k).copy() for c, k in (("code", np.int64), ("upper", float), ("lower", float)))
                reassign(x, code, upper, lower, books)
            state = [listed(code, pa.int8()), listed(upper, pa.float64()), listed(lower, pa.float64())]
            kept = ["vec_id", "label", "x"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *state], names=[*kept, "code", "upper", "lower"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label", "x"))
    return rows.mapInArrow(tidied(step), f"{kinds}, {_STATE}")


def _updated(state: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry becomes ``floor(sum / count)`` of its parts, componentwise; an unused one stays."""
    parts, entries, part = books.entries.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, part), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = matrix(batch["x"], parts * part).reshape(-1, parts, part)
            cell = matrix(batch["code"], parts) + np.arange(parts) * entries
            count += np.bincount(cell.ravel(), minlength=len(count))
            order = np.argsort(cell.ravel(), kind="stable")
            cells, first = np.unique(cell.ravel()[order], return_index=True)
            total[cells] += np.add.reduceat(x.reshape(-1, part)[order], first, axis=0)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), listed(total[used], pa.int64())], names=["cell", "n", "s"])

    sums = state.select("x", "code").mapInArrow(tidied(add), "cell bigint, n bigint, s array<bigint>")
    totals = [F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(part)]
    new = books.entries.reshape(parts * entries, part).copy()
    for row in sums.groupBy("cell").agg(F.sum("n").alias("n"), *totals).collect():
        new[row.cell] = [int(row[f"s{i}"]) // row.n for i in range(part)]
    return books.after(new.reshape(books.entries.shape))


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of ``vectors(vec_id, embedding, label)``, and the codebooks.

    ``code`` is an array of indexes by part, ``error`` the squared distances summed over parts. Rows whose
    vector is null, or holds null or non-finite components, have no row. Codebooks start as the parts of
    the rows with the smallest ids (null ids last; rows of one id by their integers); of fewer rows
    than ``ENTRIES`` there are as many entries, and repeated rows give equal entries, of which only the
    lower one is used. An empty table gives no rows. Lengths that differ, that 8 does not divide or that are 0,
    and scaled components of ``MOST`` or more, are errors. Other columns are ignored.
    """
    rows = integer_vectors(vectors, SCALE, MOST, "vec_id", "label").withColumn("x", F.col("x").cast("array<int>"))
    size = width(rows)
    if size % PARTS:
        raise ValueError(f"vectors of {size} components cannot be cut into {PARTS} equal parts")
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(ENTRIES).collect()
    if not least or not size:
        if least:
            raise ValueError("vectors have no components")
        return rows.select("vec_id", "label", F.array().cast("array<tinyint>").alias("code"), F.lit(0).cast("bigint").alias("error")), Codebooks.first(np.zeros((PARTS, 0, 0), np.int64))
    start = np.array([r.x for r in least], np.int64).reshape(len(least), PARTS, size // PARTS)
    books = Codebooks.first(start.transpose(1, 0, 2).copy())
    state = rows
    for k in range(rounds):
        before, state = state, materialise(_assigned(state, books, not k), "codes")
        if k:
            discard(before)
        books = _updated(state, books)
    state = materialise(_assigned(state, books, not rounds), "codes")
    return _with_error(state, books), books


def _with_error(state: DataFrame, books: Codebooks) -> DataFrame:
    parts, _, part = books.entries.shape

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, code = matrix(batch["x"], parts * part).reshape(-1, parts, part), matrix(batch["code"], parts)
            gap = x - books.entries[np.arange(parts), code]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["code"], pa.array((gap * gap).sum((1, 2)))], names=["vec_id", "label", "code", "error"])

    kinds = ", ".join(f"{c} {state.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return state.select("vec_id", "label", "x", "code").mapInArrow(measure, f"{kinds}, code array<tinyint>, error bigint")


def code_string(code: F.Column) -> F.Column:
    """Two hex digits for each index, in part order."""
    return F.lower(F.array_join(F.transform(code, lambda c: F.lpad(F.hex(c.cast("bigint")), 2, "0")), ""))


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``: the errors' sum over rows of an equal label, null labels together."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
