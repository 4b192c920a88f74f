"""Discrete Fourier transforms of series of any length, prime or not, over many tasks.

A transform of n values is a convolution with a chirp (``2 k t = k^2 + t^2 - (k - t)^2``), which is taken on a circle of
m values, a power of two of at least 2 n - 1. A transform of m values is split into short ones: over places of
one residue, then, after a twist, over residues. Forward and backward transforms meet in the middle:
the task that ends the one for its frequencies begins the other. So there are three shuffles, and
each task holds about the root of m values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans import ranges
from tideline.plans.decompose import observed


def _circle(n: int) -> tuple[int, int]:
    """Residues and places of one residue, for n values."""
    bits = max(2 * n - 2, 1).bit_length()
    return 1 << (bits // 2), 1 << (bits - bits // 2)


def _chirp(t: np.ndarray, n: int) -> np.ndarray:
    return np.exp(1j * np.pi * ((t * t) % (2 * n)) / n)


def _columns(values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{k}_{p}": getattr(v, p) for k, v in values.items() for p in ("real", "imag")}


def magnitudes(df: DataFrame, top: int) -> DataFrame:
    """(series_id, n, k, magnitude) of each series' centred values: at least the ``top`` strongest frequencies k / n, k from 1 to n / 2.

    n is ``max(t) + 1``. Missing values and absent rows count as the mean.
    """
    kind = df.schema["series_id"].dataType.simpleString()
    sizes = df.groupBy("series_id").agg((F.max("t") + 1).alias("n"), F.avg(F.when(observed(), F.col("y"))).alias("mean"))
    sizes = sizes.withColumn("residues", F.expr("shiftleft(1L, int(length(bin(greatest(2 * n - 2, 1L))) / 2))"))
    marks = sizes.select("series_id", "n", "mean", F.explode(F.sequence(F.lit(0).cast("long"), F.col("residues") - 1)).alias("part"))
    known = sizes.select(F.col("series_id").alias("_of"), "residues")
    rows = df.where(observed()).select("series_id", "t", "y").join(known, F.col("series_id").eqNullSafe(F.col("_of")))
    rows = rows.select("series_id", F.pmod("t", "residues").alias("part"), "t", "y")

    def begin(some: pa.Table, mark: pa.Table) -> pa.Table:
        """Short transforms over the places of one residue, of the values on their chirp and of the chirp itself."""
        n, r, mean = mark["n"][0].as_py(), mark["part"][0].as_py(), mark["mean"][0].as_py()
        residues, places = _circle(n)
        m = residues * places
        a, b = np.zeros(places, complex), np.zeros(places, complex)
        t = some["t"].to_numpy()
        a[(t - r) // residues] = (some["y"].to_numpy() - (mean or 0.0)) * _chirp(t, n).conj()
        j = r + residues * np.arange(places)
        near = np.minimum(j, m - j)
        b[near < n] = _chirp(near[near < n], n)
        turn = np.exp(-2j * np.pi * (r * np.arange(places) % m) / m)
        out = _columns({"a": np.fft.fft(a) * turn, "b": np.fft.fft(b) * turn})
        same = {"series_id": mark["series_id"].take(pa.array(np.zeros(places, np.int64)))}
        return pa.table(same | {"n": np.full(places, n), "key": np.arange(places), "at": np.full(places, r)} | out)

    def middle(key: tuple, some: pa.Table) -> pa.Table:
        """Ends the transform for the frequencies of one residue, multiplies, and begins the way back."""
        some, n, first = some.sort_by("at"), some["n"][0].as_py(), key[1].as_py()
        residues, places = _circle(n)
        m = residues * places
        a, b = (np.fft.fft(some[f"{c}_real"].to_numpy() + 1j * some[f"{c}_imag"].to_numpy()) for c in ("a", "b"))
        turn = np.exp(2j * np.pi * (first * np.arange(residues) % m) / m)
        out = _columns({"c": np.fft.ifft(a * b) * turn})
        return pa.table({"series_id": some["series_id"], "n": some["n"], "key": np.arange(residues), "at": np.full(residues, first)} | out)

    def end(key: tuple, some: pa.Table) -> pa.Table:
        some, n, first = some.sort_by("at"), some["n"][0].as_py(), key[1].as_py()
        residues, places = _circle(n)
        size = np.abs(np.fft.ifft(some["c_real"].to_numpy() + 1j * some["c_imag"].to_numpy()))
        k = first + residues * np.arange(places)
        here = np.flatnonzero((k >= 1) & (k <= n // 2))
        strong = here[np.lexsort((k[here], -size[here]))[:top]]
        same = {c: some[c].take(pa.array(np.zeros(len(strong), np.int64))) for c in ("series_id", "n")}
        return pa.table(same | {"k": k[strong].astype(np.int64), "magnitude": size[strong]})

    head = f"series_id {kind}, n bigint"
    pairs = lambda *names: ", ".join(f"{c}_{p} double" for c in names for p in ("real", "imag"))
    one = ranges.cogroup(rows, F.col("part"), marks, begin, f"{head}, key bigint, at bigint, {pairs('a', 'b')}")
    two = one.groupBy("series_id", "key").applyInArrow(middle, f"{head}, key bigint, at bigint, {pairs('c')}")
    return two.groupBy("series_id", "key").applyInArrow(end, f"{head}, k bigint, magnitude double")
