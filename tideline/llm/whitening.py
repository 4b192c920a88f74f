"""Whitening of embeddings: the leading principal components, scaled to unit variance.

Components become integers ``x = floor(256 * c)``; the fit list is each distinct ``x`` once. Rows are centred
exactly, as ``(n * x - S) / n`` from integers, before anything is multiplied; a ``RowMatrix`` gives the Gram
matrix of the centred rows, the driver its eigenvectors, and the few leading ones go to all tasks,
which project every row on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import materialise
from tideline.llm.vectors import component_sums, integer_vectors, width

SCALE, COMPONENTS = 256, 4
#: Scaled components lie below this magnitude, so that doubles hold them exactly.
MOST = 1 << 40

WHITENED = "vec_id {}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """Of the fit list: its rows ``n``, sums by dimension, and the leading components as columns with their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows, components): centred rows of integers on the components, over their deviations."""
        return self._centred(x) @ self.axes / np.sqrt(self.values)

    def _centred(self, x: np.ndarray) -> np.ndarray:
        sums = np.array(self.sums, object)
        exact = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0) < 1 << 62
        gap = x * np.int64(self.n) - sums.astype(np.int64) if exact else x.astype(object) * self.n - sums
        return np.asarray(gap / self.n, float)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """``sum (n * x - S)^2`` of each row, exact; null where it exceeds 64 bits."""
        sums = np.array(self.sums, object)
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if most * most * max(len(sums), 1) < 1 << 63:
            gap = x * np.int64(self.n) - sums.astype(np.int64)
            return (gap * gap).sum(1).tolist()
        found = (((x.astype(object) * self.n - sums) ** 2).sum(1)).tolist()
        return [v if v < 1 << 63 else None for v in found]


def fit(rows: DataFrame, size: int, components: int = COMPONENTS) -> tuple[Whitening, DataFrame]:
    """The whitening of ``rows(x)`` over each distinct ``x`` once, and the written fit list.

    Components whose eigenvalue is 0 to rounding are left out, so that fewer may come back.
    """
    distinct = materialise(rows.select("x").distinct(), "fit")
    n = distinct.count()
    sums = component_sums(distinct, size)
    total = F.array(*[F.lit(s).cast("bigint") for s in sums])
    # integers up to here; the one rounding is that of the division
    centred = distinct.select(array_to_vector(F.zip_with("x", total, lambda x, s: (x * F.lit(n) - s).cast("double") / F.lit(float(n)))).alias("row"))
    gram = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "row")).computeGramianMatrix().toArray()
    covariance = (gram + gram.T) / 2 / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    trace = float(np.trace(covariance))
    used = int((values[:components] > trace * size * 1e-14).sum()) if trace > 0 else 0
    return Whitening(n, tuple(sums), np.ascontiguousarray(axes[:, :used]), values[:used].copy(), trace), distinct


def _stacked(column: pd.Series, size: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64).reshape(len(column), size) if len(column) else np.zeros((0, size), np.int64)


def identity_error(distinct: DataFrame, model: Whitening, size: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance (divisor n) less the identity."""
    k = len(model.values)
    names = [f"w{i}" for i in range(k)]

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(model.whitened(_stacked(batch["x"], size)), columns=names)

    white = distinct.mapInPandas(project, ", ".join(f"{c} double" for c in names))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``vectors(vec_id, embedding)``.

    One row for each whole vector and component, numbered from 1 by falling eigenvalue. Rows whose vector is
    null, or holds null or non-finite components, have none; repeated rows have one each, and count once
    in the fit. A null id is kept. Components without variance (one distinct vector, fewer dimensions, an
    empty table) have no row; equal eigenvalues come in the order of the eigenvectors found.
    ``deviation`` is null beyond 64 bits. Vectors of different lengths, and scaled components of ``MOST`` or
    more, are errors. Other columns are ignored.
    """
    rows = integer_vectors(vectors, SCALE, MOST, "vec_id")
    kind = rows.schema["vec_id"].dataType.simpleString()
    size = width(rows)
    model, distinct = fit(rows, size, components) if size else (None, None)
    if not model or not len(model.values):
        return rows.sparkSession.createDataFrame([], WHITENED.format(kind))
    error = identity_error(distinct, model, size)
    k, explained = len(model.values), model.values / model.trace

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _stacked(batch["x"], size)
            at = np.repeat(np.arange(len(x)), k)
            yield pd.DataFrame({
                "vec_id": batch["vec_id"].iloc[at].to_numpy(), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)), "n": model.n,
                "deviation": pd.array(model.deviation(x), "Int64")[at], "whitened": model.whitened(x).ravel(), "explained": np.tile(explained, len(x)), "identity_error": error,
            })

    return rows.mapInPandas(project, WHITENED.format(kind))
