"""Piecewise-constant trends of series of any length, exact, by messages between ranges.

``min (1/T) sum over observed (y - x)^2 + weight / (T - 1) * sum |x_t+1 - x_t|``. Going forward, the slope of the
best cost of all points so far, as a function of the last one's level, is a rising piecewise-linear
function: the message. A point's penalty clips it to a bound on both sides, and its data adds a line.
For a fixed level a whole part therefore takes an incoming slope v to ``clip(v + S, L, U)``: S is a line, and
L and U are the messages that the part makes of the lower and the upper bound. So parts are folded first, each
in its task; then messages pass over the parts' three functions, a row each; then each part runs
forward from its own incoming message. Going back, a level is the next one clipped to the two places
where its message met the bounds; clips of clips are clips, so this passes over parts in the same way.
A message holds the breakpoints that clipping has left, no more than the places of its part and of the one before.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans import ranges
from tideline.plans.decompose import observed
from tideline.plans.specs import Component

Message = tuple[np.ndarray, np.ndarray]

_FOLDED = "part bigint, total bigint, seen bigint, sum double, lx array<double>, lv array<double>, ux array<double>, uv array<double>"
_SENT = "part bigint, total bigint, mx array<double>, mv array<double>"


def forward(y: np.ndarray, slope: float, bound: float, message: Message, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Message:
    """The message after the points ``y`` (NaN: unobserved); fills in where each one's message meets the bounds.

    A message is (places, slopes there), straight between and constant outside.
    """
    xs, vs = message
    rise = np.diff(vs) / np.diff(xs) if len(xs) > 1 else np.zeros(0)
    lines = [(0.0, vs[0]), *[(a, v - a * x) for a, x, v in zip(rise, xs[:-1], vs[:-1], strict=True)], (0.0, vs[-1])]
    bends = deque((x, lines[i + 1][0] - lines[i][0], lines[i + 1][1] - lines[i][1]) for i, x in enumerate(xs.tolist())) if len(xs) > 1 else deque()
    (la, lb), (ra, rb) = lines[0], lines[-1]
    for t, value in enumerate(y.tolist()):
        if value == value:
            la, lb, ra, rb = la + slope, lb - slope * value, ra + slope, rb - slope * value
        while bends and la * bends[0][0] + lb <= -bound:
            _, da, db = bends.popleft()
            la, lb = la + da, lb + db
        at = -np.inf
        if la > 0:
            at = (-bound - lb) / la
            bends.appendleft((at, la, lb + bound))
            la, lb = 0.0, -bound
        if low is not None:
            low[t] = at
        while bends and ra * bends[-1][0] + rb >= bound:
            _, da, db = bends.pop()
            ra, rb = ra - da, rb - db
        at = np.inf
        if ra > 0:
            at = (bound - rb) / ra
            bends.append((at, -ra, bound - rb))
            ra, rb = 0.0, bound
        if high is not None:
            high[t] = at
    if not bends:
        return np.zeros(1), np.array([lb])
    places, values, a, b = [], [], la, lb
    for x, da, db in bends:
        places.append(x)
        values.append(a * x + b)
        a, b = a + da, b + db
    return np.array(places), np.array(values)


def passed(message: Message, gain: float, sums: float, lower: Message, upper: Message) -> Message:
    """``clip(message + gain * x - sums, lower, upper)``: what a part makes of a message."""
    x = np.unique(np.concatenate([message[0], lower[0], upper[0]]))
    if gain > 0:  # beyond all places the line alone decides, until it meets the bounds
        reach = lambda v, at: (v - np.interp(at, *message) + sums) / gain
        x = np.concatenate([[min(x[0], reach(lower[1][0], x[0]), reach(upper[1][0], x[0])) - 1.0], x, [max(x[-1], reach(upper[1][-1], x[-1]), reach(lower[1][-1], x[-1])) + 1.0]])
    line = np.interp(x, *message) + gain * x - sums
    more = [x]
    for bound in (lower, upper):
        gap = line - np.interp(x, *bound)
        cross = np.flatnonzero(gap[:-1] * gap[1:] < 0)
        more.append(x[cross] + (x[cross + 1] - x[cross]) * gap[cross] / (gap[cross] - gap[cross + 1]))
    x = np.unique(np.concatenate(more))
    v = np.clip(np.interp(x, *message) + gain * x - sums, np.interp(x, *lower), np.interp(x, *upper))
    kept = np.ones(len(x), bool)  # constant ends need one place each
    kept[1:-1] = (v[1:-1] != v[0]) & (v[1:-1] != v[-1])
    kept[:-1] |= v[1:] != v[:-1]
    kept[1:] |= v[1:] != v[:-1]
    return (x[kept], v[kept]) if kept.any() else (x[:1], v[:1])


def _places(rows: pa.Table, start: int, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    n = min(size, total - start)
    y, at = np.full(n, np.nan), rows["t"].to_numpy() - start
    y[at] = rows["_y"].to_numpy(zero_copy_only=False).astype(float)
    return y, at


def pwc_curves(df: DataFrame, component: Component, size: int | None = None) -> DataFrame:
    """``df`` with the role of a ``pwc`` part alone under l2, residual and reconstruction, for series of any length.

    One row a place at most; places without a row are unobserved. A series without observed values has nulls.
    """
    if component.kind != "pwc" or component.lower is not None or component.upper is not None:
        raise ValueError("a piecewise-constant part without bounds is needed")
    size, role, weight = size or ranges.RANGE_ROWS, component.role, component.params["weight"]
    kind = df.schema["series_id"].dataType.simpleString()
    rows = ranges.by_place(df, size).withColumn("_y", F.when(observed(), F.col("y")).cast("double"))
    lengths = df.groupBy("series_id").agg((F.max("t") + 1).alias("total"))
    marks = lengths.select("series_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(size).cast("long"))).alias("part"))
    bound_of = lambda total: weight / max(total - 1, 1)
    many = pa.list_(pa.float64())

    def fold(some: pa.Table, mark: pa.Table) -> pa.Table:
        start, total = mark["part"][0].as_py(), mark["total"][0].as_py()
        y, _ = _places(some, start, total, size)
        bound = bound_of(total)
        ends = [forward(y, 2 / total, bound, (np.zeros(1), np.array([v]))) for v in (-bound, bound)]
        out = {"series_id": mark["series_id"].slice(0, 1), "part": [start], "total": [total], "seen": [int(np.isfinite(y).sum())], "sum": [float(np.nansum(y))]}
        return pa.table(out | {c: pa.array([v], many) for c, v in zip(("lx", "lv", "ux", "uv"), (*ends[0], *ends[1]), strict=True)})

    def send(parts: pa.Table) -> pa.Table:
        """Each part's incoming message; after the last part, at its end, comes the last message."""
        parts, message, sent = parts.sort_by("part"), (np.zeros(1), np.zeros(1)), []
        total = parts["total"][0].as_py()
        for r in parts.to_pylist():
            sent.append(message)
            lower, upper = ((np.array(r[a]), np.array(r[b])) for a, b in (("lx", "lv"), ("ux", "uv")))
            message = passed(message, 2 / total * r["seen"], 2 / total * r["sum"], lower, upper)
        sent.append(message)
        which = pa.array([*range(len(parts)), 0])
        part = pa.array([*parts["part"].to_pylist(), -1], pa.int64())
        return pa.table({"series_id": parts["series_id"].take(which), "part": part, "total": parts["total"].take(which), "mx": pa.array([m[0] for m in sent], many), "mv": pa.array([m[1] for m in sent], many)})

    def bounds(some: pa.Table, sent: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, total = sent["part"][0].as_py(), sent["total"][0].as_py()
        y, at = _places(some, start, total, size)
        low, high = np.empty(len(y)), np.empty(len(y))
        forward(y, 2 / total, bound_of(total), (np.array(sent["mx"][0].as_py()), np.array(sent["mv"][0].as_py())), low, high)
        return low, high, at

    def clips(some: pa.Table, sent: pa.Table) -> pa.Table:
        """The clip that a part makes of the level after it; of the last message, the place where its slope is 0."""
        x, v = np.array(sent["mx"][0].as_py()), np.array(sent["mv"][0].as_py())
        if sent["part"][0].as_py() < 0:
            known = len(x) > 1
            low = high = float(np.interp(0.0, v, x)) if known else np.nan
        else:
            low, high = -np.inf, np.inf
            lows, highs, _ = bounds(some, sent)
            for a, b in zip(lows.tolist()[::-1], highs.tolist()[::-1], strict=True):
                low, high = min(max(low, a), b), min(max(high, a), b)
        return pa.table({"series_id": sent["series_id"], "part": sent["part"], "low": pa.array([low], pa.float64()), "high": pa.array([high], pa.float64())})

    def back(parts: pa.Table) -> pa.Table:
        """The level after each part."""
        parts = parts.sort_by("part")
        level, after = parts["low"][0].as_py(), []
        for a, b in zip(parts["low"].to_pylist()[:0:-1], parts["high"].to_pylist()[:0:-1], strict=True):
            after.append(level)
            level = min(max(level, a), b)
        return parts.select(["series_id", "part"]).slice(1).append_column("next", pa.array(after[::-1], pa.float64()))

    def fill(some: pa.Table, sent: pa.Table) -> pa.Table:
        low, high, at = bounds(some, sent)
        x, level = np.empty(len(low)), sent["next"][0].as_py()
        for t in range(len(low) - 1, -1, -1):
            level = min(max(level, low[t]), high[t])
            x[t] = level
        value = pa.array(x[at], from_pandas=True)
        return some.drop_columns(["_y"]).append_column("_x", value)

    part = F.col("part")
    slim = rows.select("series_id", "part", "t", "_y")
    folded = ranges.cogroup(slim, part, marks, fold, f"series_id {kind}, {_FOLDED}")
    sent = folded.groupBy("series_id").applyInArrow(send, f"series_id {kind}, {_SENT}")
    clipped = ranges.cogroup(slim, part, sent, clips, f"series_id {kind}, part bigint, low double, high double")
    after = clipped.groupBy("series_id").applyInArrow(back, f"series_id {kind}, part bigint, next double")
    after = after.select(F.col("series_id").alias("_s"), F.col("part").alias("_p"), "next")
    ends = sent.join(after, F.col("series_id").eqNullSafe(F.col("_s")) & (part == F.col("_p"))).drop("_s", "_p")
    wide = rows.select("series_id", "part", *[c for c in df.columns if c != "series_id"], "_y")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema if f.name != "_y") + ", _x double"
    out = ranges.cogroup(wide, part, ends, fill, schema)
    x = F.when(~F.isnan("_x"), F.col("_x"))
    left = F.when(observed(), F.col("y") - x).when(x.isNotNull(), F.lit(0.0))
    return out.select(*df.columns, x.alias(role), x.alias("reconstruction"), left.alias("residual"))
