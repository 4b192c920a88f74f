"""Smooth trends of series of any length: one banded system, solved by ranges.

``min (1/T) sum over observed (y - x)^2 + weight * sum (differences of x of an order)^2`` couples a point
with ``order`` points on each side only. A part's inner points are eliminated in its own task, which
leaves a small quadratic in its last ``order`` points and those of the part before. Such nodes are
merged in a tree, a group of neighbours at a time, until one is left; values are then handed down the same
tree, and each part fills in its inner points. A task holds a part's rows or a group's nodes.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans import ranges
from tideline.plans.decompose import design, observed
from tideline.plans.specs import Model

#: Points that are eliminated together, and nodes that are merged in one task.
BLOCK, FAN = 32, 512

_NODE = "part bigint, total bigint, m array<double>, g array<double>"
_ENDS = "part bigint, total bigint, left array<double>, right array<double>"


def _blocks(n: int, start: int, total: int, seen: np.ndarray, rhs: np.ndarray, weight: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A part's quadratic by blocks, each over the ``k`` points before it and its own; points beyond the series stand alone."""
    count = -(-n // BLOCK)
    stencil = np.array([(-1.0) ** (k - i) * comb(k, i) for i in range(k + 1)])
    d = np.zeros((BLOCK, k + BLOCK))
    for i in range(BLOCK):
        d[i, i : i + k + 1] = stencil
    at = start + np.arange(count * BLOCK)
    valid = ((at >= k) & (at < total)).reshape(count, BLOCK)
    h = np.tile(weight * d.T @ d, (count, 1, 1))
    for j in np.flatnonzero(~valid.all(1)):
        h[j] = weight * d[valid[j]].T @ d[valid[j]]
    own = np.where(at < total, 0.0, 1.0)
    own[:n] += seen / total
    g = np.zeros((count * BLOCK, rhs.shape[1]))
    g[:n] = np.where(seen[:, None] > 0, rhs, 0.0) / total
    inner = np.arange(k, k + BLOCK)
    h[:, inner, inner] += own.reshape(count, BLOCK)
    return h, np.concatenate([np.zeros((count, k, rhs.shape[1])), g.reshape(count, BLOCK, -1)], 1)


def _eliminate(h: np.ndarray, g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """What blocks leave on their (left, right) ends, ``2 k`` points."""
    ends, inner = np.r_[0:k, BLOCK : BLOCK + k], np.arange(k, BLOCK)
    across = h[:, inner[:, None], ends]
    solved = np.linalg.solve(h[:, inner[:, None], inner], np.concatenate([across, g[:, inner]], 2))
    left = across.transpose(0, 2, 1)
    return h[:, ends[:, None], ends] - left @ solved[:, :, : 2 * k], g[:, ends] - left @ solved[:, :, 2 * k :]


def _pairs(m: np.ndarray, g: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours merged two by two; a last one without a neighbour stays."""
    h = len(m) // 2
    a, b, ga, gb = m[0 : 2 * h : 2], m[1 : 2 * h : 2], g[0 : 2 * h : 2], g[1 : 2 * h : 2]
    middle = a[:, k:, k:] + b[:, :k, :k]
    across = np.concatenate([a[:, k:, :k], b[:, :k, k:]], 2)  # the middle against left and right
    solved = np.linalg.solve(middle, np.concatenate([across, ga[:, k:] + gb[:, :k]], 2))
    left = across.transpose(0, 2, 1)
    new = -left @ solved[:, :, : 2 * k]
    new[:, :k, :k] += a[:, :k, :k]
    new[:, k:, k:] += b[:, k:, k:]
    rest = np.concatenate([ga[:, :k], gb[:, k:]], 1) - left @ solved[:, :, 2 * k :]
    return np.concatenate([new, m[2 * h :]]), np.concatenate([rest, g[2 * h :]])


def _tree(m: np.ndarray, g: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    levels = [(m, g)]
    while len(levels[-1][0]) > 1:
        levels.append(_pairs(*levels[-1], k))
    return levels


def _spread(levels: list[tuple[np.ndarray, np.ndarray]], left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Both ends' values of every node of the first level, from those of the last level's only node."""
    lefts, rights = left[None], right[None]
    for m, g in reversed(levels[:-1]):
        h = len(m) // 2
        a, b = m[0 : 2 * h : 2], m[1 : 2 * h : 2]
        force = g[0 : 2 * h : 2, k:] + g[1 : 2 * h : 2, :k] - a[:, k:, :k] @ lefts[:h] - b[:, :k, k:] @ rights[:h]
        middle = np.linalg.solve(a[:, k:, k:] + b[:, :k, :k], force)
        new_l, new_r = np.empty((len(m), *left.shape)), np.empty((len(m), *left.shape))
        new_l[0 : 2 * h : 2], new_r[0 : 2 * h : 2] = lefts[:h], middle
        new_l[1 : 2 * h : 2], new_r[1 : 2 * h : 2] = middle, rights[:h]
        new_l[2 * h :], new_r[2 * h :] = lefts[h:], rights[h:]
        lefts, rights = new_l, new_r
    return lefts, rights


def _filled(h: np.ndarray, g: np.ndarray, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """A part's values, from those on its ends."""
    lefts, rights = _spread(_tree(*_eliminate(h, g, k), k), left, right, k)
    ends, inner = np.r_[0:k, BLOCK : BLOCK + k], np.arange(k, BLOCK)
    both = np.concatenate([lefts, rights], 1)
    x = np.linalg.solve(h[:, inner[:, None], inner], g[:, inner] - h[:, inner[:, None], ends] @ both)
    return np.concatenate([x, rights], 1).reshape(-1, g.shape[2])


def _part(rows: pa.Table, names: list[str], start: int, total: int, size: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A part's points, its rows' places in it, which points are observed, and their right sides."""
    n = min(size, total - start)
    at = rows["t"].to_numpy() - start
    seen, rhs = np.zeros(n), np.zeros((n, len(names)))
    seen[at] = rows["_seen"].to_numpy(zero_copy_only=False)
    for i, c in enumerate(names):
        rhs[at, i] = np.nan_to_num(rows[c].to_numpy(zero_copy_only=False).astype(float))
    return n, at, seen, rhs


def smooth_solve(df: DataFrame, columns: Mapping[str, Column], weight: float, order: int = 2, size: int | None = None) -> DataFrame:
    """``df`` with, for each right side in ``columns``, the solution of the trend's system.

    ``(S / T + weight * D'D) x = S c / T`` with S the rows where y is observed, T the length ``max(t) + 1``
    and D the differences of ``order``. ``df`` has one row a place at most; places without a row are
    unobserved. A series with fewer observed rows than ``order`` gets a solution of least size at its end.
    """
    k, names = order, list(columns)
    size = -(-(size or ranges.RANGE_ROWS) // BLOCK) * BLOCK  # whole blocks
    if not 1 <= k < BLOCK:
        raise ValueError(f"an order of 1 to {BLOCK - 1} is needed")
    q, kind = len(names), df.schema["series_id"].dataType.simpleString()
    rows = ranges.by_place(df, size).withColumns({c: e.cast("double") for c, e in columns.items()} | {"_seen": observed().cast("double")})
    lengths = df.groupBy("series_id").agg((F.max("t") + 1).alias("total"))
    longest = lengths.agg(F.max("total")).first()[0] or 0
    marks = lengths.select("series_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(size).cast("long"))).alias("part"))
    slim = rows.select("series_id", "part", "t", "_seen", *names)

    def condense(some: pa.Table, mark: pa.Table) -> pa.Table:
        start, total = mark["part"][0].as_py(), mark["total"][0].as_py()
        n, _, seen, rhs = _part(some, names, start, total, size)
        m, g = _tree(*_eliminate(*_blocks(n, start, total, seen, rhs, weight, k), k), k)[-1]
        return pa.table({"series_id": mark["series_id"].slice(0, 1), "part": [start], "total": [total], "m": [m.ravel()], "g": [g.ravel()]})

    def opened(some: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        some = some.sort_by("part")
        m, g = (np.array(some[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)) for c in ("m", "g"))
        return some, m.reshape(-1, 2 * k, 2 * k), g.reshape(-1, 2 * k, q)

    def merge(key: tuple, some: pa.Table) -> pa.Table:
        some, m, g = opened(some)
        m, g = _tree(m, g, k)[-1]
        return pa.table({"series_id": some["series_id"].slice(0, 1), "part": [key[1].as_py()], "total": some["total"].slice(0, 1), "m": [m.ravel()], "g": [g.ravel()]})

    def top(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            some, m, g = opened(pa.Table.from_batches([batch]))
            right = [np.linalg.lstsq(a[k:, k:], b[k:], rcond=1e-15)[0].ravel() for a, b in zip(m, g, strict=True)]
            yield from ended(some, [np.zeros(k * q)] * len(right), right).to_batches()

    def spread(some: pa.Table, ends: pa.Table) -> pa.Table:
        some, m, g = opened(some)
        left, right = (np.array(ends[c][0].as_py()).reshape(k, q) for c in ("left", "right"))
        lefts, rights = _spread(_tree(m, g, k), left, right, k)
        return ended(some, [x.ravel() for x in lefts], [x.ravel() for x in rights])

    def ended(some: pa.Table, left: list, right: list) -> pa.Table:
        many = pa.list_(pa.float64())
        return some.select(["series_id", "part", "total"]).append_column("left", pa.array(left, many)).append_column("right", pa.array(right, many))

    keys = ["series_id", "part"]
    levels = [ranges.cogroup(slim, F.col("part"), marks, condense, f"series_id {kind}, {_NODE}")]
    width = size
    while width < longest:
        width *= FAN
        group = (F.col("part") - F.pmod(F.col("part"), F.lit(width))).alias("group")
        levels.append(levels[-1].groupBy("series_id", group).applyInArrow(merge, f"series_id {kind}, {_NODE}"))
    ends = levels[-1].mapInArrow(top, f"series_id {kind}, {_ENDS}")
    for nodes in reversed(levels[:-1]):
        group = (F.col("part") - F.pmod(F.col("part"), F.lit(width))).alias("group")
        ends = ranges.cogroup(nodes, group, ends, spread, f"series_id {kind}, {_ENDS}")
        width //= FAN

    def fill(some: pa.Table, end: pa.Table) -> pa.Table:
        start, total = end["part"][0].as_py(), end["total"][0].as_py()
        n, at, seen, rhs = _part(some, names, start, total, size)
        left, right = (np.array(end[c][0].as_py()).reshape(k, q) for c in ("left", "right"))
        x = _filled(*_blocks(n, start, total, seen, rhs, weight, k), left, right, k)[at]
        for i, c in enumerate(names):
            some = some.set_column(some.schema.get_field_index(c), c, pa.array(x[:, i]))
        return some.drop_columns(["_seen"])

    wide = rows.select(*keys, *[c for c in df.columns if c != "series_id" and c not in names], *names, "_seen")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema if f.name != "_seen")
    return ranges.cogroup(wide, F.col("part"), ends, fill, schema).drop("part")


def smooth_curves(df: DataFrame, model: Model, size: int | None = None) -> DataFrame:
    """``df`` with each role, residual and reconstruction of a model of one ``smooth`` part under l2, for series of any length.

    Other parts may be any that ``gram_fit`` fits. Their columns are smoothed beside y, which leaves a small
    system of sums for their coefficients.
    """
    smooth = [c for c in model.components if c.kind == "smooth"]
    if model.loss != "l2" or len(smooth) != 1 or smooth[0].lower is not None or smooth[0].upper is not None:
        raise ValueError("one smooth part without bounds under l2 is needed")
    trend, rest = smooth[0], [c for c in model.components if c.kind != "smooth"]
    columns, penalty = design(Model(tuple(rest))) if rest else ([], np.zeros(0))
    p, seen = len(columns), observed()
    named = {f"_b{i}": c for i, c in enumerate(columns)}
    rows = smooth_solve(df, {"_x": F.col("y"), **named}, trend.params["weight"], trend.params["order"], size)
    if not p:
        return _finished(rows.withColumnRenamed("_x", trend.role), df, model)
    # the normal equations of the coefficients once the trend is eliminated
    left = lambda i: F.when(seen, columns[i].cast("double"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    a = F.array(*[total(left(i) * (columns[j].cast("double") - F.col(f"_b{j}"))) for i in range(p) for j in range(p)])
    b = F.array(*[total(left(i) * (F.col("y") - F.col("_x"))) for i in range(p)])
    sums = rows.groupBy("series_id").agg(a.alias("a"), b.alias("b"), (F.max("t") + 1).alias("n"))

    def solve_each(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            theta = []
            for a, b, n in zip(*(batch[c].to_pylist() for c in ("a", "b", "n")), strict=True):
                theta.append(np.linalg.lstsq(np.array(a).reshape(p, p) / n + np.diag(penalty), np.array(b) / n, rcond=1e-13)[0])
            yield pa.RecordBatch.from_pydict({"_of": batch["series_id"], "theta": theta})

    fitted = sums.mapInArrow(solve_each, f"_of {df.schema['series_id'].dataType.simpleString()}, theta array<double>")
    out, at = rows.join(fitted, F.col("series_id").eqNullSafe(F.col("_of"))), 0
    value = lambda cs: sum((c * F.element_at("theta", at + i + 1) for i, c in cs[1:]), cs[0][1] * F.element_at("theta", at + 1))
    moved = sum((F.col(f"_b{i}") * F.element_at("theta", i + 1) for i in range(1, p)), F.col("_b0") * F.element_at("theta", 1))
    out = out.withColumn(trend.role, F.col("_x") - moved)
    for c in rest:
        some = design(Model((c,)))[0]
        out, at = out.withColumn(c.role, value(list(enumerate(s.cast("double") for s in some)))), at + len(some)
    return _finished(out, df, model)


def smooth_dof(df: DataFrame, weight: float, order: int = 2, probes: int = 32, size: int | None = None) -> DataFrame:
    """(series_id, dof): the trace of a smooth trend's influence matrix, estimated by random signs as further right sides.

    Signs are hashes of series, place and probe, so that reruns agree.
    """
    signs = {f"_z{i}": F.when(F.pmod(F.xxhash64("series_id", "t", F.lit(i)), F.lit(2)) == 0, 1.0).otherwise(-1.0) for i in range(probes)}
    rows = smooth_solve(df, signs, weight, order, size)
    each = sum((F.sum(F.when(observed(), signs[c] * F.col(c))) for c in signs), F.lit(0.0))
    return rows.groupBy("series_id").agg((each / probes).alias("dof"))


def _finished(rows: DataFrame, df: DataFrame, model: Model) -> DataFrame:
    total = sum((F.col(r) for r in model.roles[1:]), F.col(model.roles[0]))
    out = rows.withColumn("reconstruction", total).withColumn("residual", F.when(observed(), F.col("y") - F.col("reconstruction")).otherwise(0.0))
    return out.select(*df.columns, *model.roles, "reconstruction", "residual")
