"""Nearest neighbours by a robust-pruned directed graph in each shard of the vectors.

Equal vectors are one node, with the least ids of its copies. Nodes are dealt into shards by a hash;
a shard's graph is built in one task: nodes are inserted in batches, a greedy beam search over the
graph so far proposes each one's neighbours, and relaxed pruning (an edge goes if a kept neighbour
is nearer to its end by the factor ``ALPHA``) keeps long and diverse edges. Reverse edges are added
and pruned alike. The graphs are written once; each block of queries then meets each shard, a beam
search finds its nodes there, and the best of all shards are merged. Distances of the result are
computed in double precision on the original vectors; graphs are built and searched on copies that are
centred and scaled by shard, so that neither offsets nor units of the vectors matter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.storage import materialise

#: Vectors of a shard on average, edges of a node, beam of the build and of a search, relaxation.
SHARD_ROWS, DEGREE, BUILD_BEAM, BEAM, ALPHA = 10_000, 28, 48, 96, 1.2
#: Neighbours asked for, queries of a block, nodes expanded and inserted at once.
K, QUERY_BLOCK, EXPAND, BATCH = 10, 100_000, 4, 256


def _squared(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of ``points`` (b, d) to ``rows`` (b, r, d)."""
    gap = rows - points[:, None, :]
    return np.einsum("brd,brd->br", gap, gap)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes met from ``start`` for each point, nearest first (-1: none), and distances.

    All points advance together; each step expands a point's nearest nodes not yet expanded.
    """
    b = len(points)
    ids = np.full((b, beam), -1, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, _squared(x[None, [start]].repeat(b, 0), points)[:, 0], False
    met = np.zeros((b, len(x)), bool)
    met[:, start] = True
    live = np.arange(b)
    while len(live):
        rank = np.argsort(done[live], axis=1, kind="stable")[:, :EXPAND]
        fresh = ~np.take_along_axis(done[live], rank, 1)
        live, rank, fresh = (a[fresh[:, 0]] for a in (live, rank, fresh))
        if not len(live):
            break
        done[live[:, None], rank] = True
        node = np.where(fresh, ids[live[:, None], rank], start)
        near = edges[node].reshape(len(live), -1)
        near = np.sort(near, axis=1)
        new = near >= 0
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        new &= ~met[live[:, None], near]
        new &= near >= 0
        row, col = np.nonzero(new)
        found = near[row, col]
        met[live[row], found] = True
        gap = x[found] - points[live[row]]
        width = int(new.sum(1).max(initial=0))
        if not width:
            continue
        place = np.cumsum(new, 1)[row, col] - 1
        more = np.full((len(live), width), -1, np.int64)
        more_dist = np.full((len(live), width), np.inf, np.float32)
        more[row, place], more_dist[row, place] = found, np.einsum("nd,nd->n", gap, gap)
        all_ids, all_dist = np.concatenate([ids[live], more], 1), np.concatenate([dist[live], more_dist], 1)
        all_done = np.concatenate([done[live], more < 0], 1)
        order = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_dist, all_done))
    return ids, dist


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` of the candidates (rows padded with -1) as edges of each node."""
    b, c = candidates.shape
    own = (candidates < 0) | (candidates == nodes[:, None])
    # seen from the node, so that the products below lose no digits to its place
    rows = x[np.where(own, 0, candidates)] - x[nodes][:, None, :]
    away = np.where(own, np.inf, np.einsum("bcd,bcd->bc", rows, rows))
    order = np.argsort(away, axis=1, kind="stable")
    candidates, away = np.take_along_axis(candidates, order, 1), np.take_along_axis(away, order, 1)
    rows = np.take_along_axis(rows, order[:, :, None], 1)
    norm = np.einsum("bcd,bcd->bc", rows, rows)
    between = norm[:, :, None] + norm[:, None, :] - 2 * (rows @ rows.transpose(0, 2, 1))
    alive = np.isfinite(away)
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    out = np.full((b, degree), -1, np.int64)
    every = np.arange(b)
    for k in range(degree):
        first = alive.argmax(1)
        has = alive[every, first]
        if not has.any():
            break
        out[has, k] = candidates[every, first][has]
        alive &= alpha * alpha * between[every, first] > away
        alive[every, first] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (n, 2 * degree), padded with -1, and the node where searches start."""
    n = len(x)
    edges = np.full((n, 2 * degree), -1, np.int64)
    used = np.zeros(n, np.int64)
    gap = x - x.mean(0, dtype=np.float64).astype(np.float32)
    start = int(np.einsum("nd,nd->n", gap, gap).argmin())
    rest = np.random.default_rng(11).permutation(np.delete(np.arange(n), start))
    at = 0
    while at < len(rest):
        batch = rest[at : at + max(1, min(BATCH, at))]
        at += len(batch)
        found, _ = beam_search(x, edges, start, x[batch], beam)
        own = robust_prune(x, batch, found, degree, alpha)
        edges[batch, :degree] = own
        used[batch] = (own >= 0).sum(1)
        _add_reverse(x, edges, used, batch, own, degree, alpha)
    return edges, start


def _add_reverse(x: np.ndarray, edges: np.ndarray, used: np.ndarray, batch: np.ndarray, own: np.ndarray, degree: int, alpha: float) -> None:
    source = np.repeat(batch, own.shape[1])[own.ravel() >= 0]
    target = own.ravel()[own.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    fits = used[nodes] + count <= edges.shape[1]
    rank = np.arange(len(target)) - np.repeat(first, count)
    ok = np.repeat(fits, count)
    edges[target[ok], used[target[ok]] + rank[ok]] = source[ok]
    used[nodes[fits]] += count[fits]
    over = np.flatnonzero(~fits)
    over = over[np.argsort(count[over], kind="stable")]
    at = 0
    while at < len(over):
        step = over[at : at + max(1, 4_000_000 // (edges.shape[1] + int(count[over[min(at + 255, len(over) - 1)]])) ** 2)][:256]
        at += len(step)
        candidates = np.full((len(step), edges.shape[1] + int(count[step].max())), -1, np.int64)
        candidates[:, : edges.shape[1]] = edges[nodes[step]]
        for k, s in enumerate(step):
            candidates[k, edges.shape[1] : edges.shape[1] + count[s]] = source[first[s] : first[s] + count[s]]
        kept = robust_prune(x, nodes[step], candidates, degree, alpha)
        edges[nodes[step]] = -1
        edges[nodes[step], :degree] = kept
        used[nodes[step]] = (kept >= 0).sum(1)


def _matrix(column: pa.ChunkedArray, dim: int, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(kind)


@dataclass(frozen=True)
class View:
    """Vectors of a shard as seen by its graph: by their largest component, from their mean, by the largest one left."""

    size: float
    centre: np.ndarray
    spread: float

    @staticmethod
    def of(exact: np.ndarray) -> View:
        size = float(np.abs(exact).max(initial=0.0)) or 1.0
        centre = (exact / size).mean(0)
        return View(size, centre, float(np.abs(exact / size - centre).max(initial=0.0)) or 1.0)

    def __call__(self, exact: np.ndarray) -> np.ndarray:
        return np.clip((exact / self.size - self.centre) / self.spread, -1e15, 1e15).astype(np.float32)


def distances(gap: np.ndarray) -> np.ndarray:
    """Euclidean lengths of ``gap`` (.., d) in double precision, also where squares leave its range."""
    with np.errstate(over="ignore", under="ignore"):
        plain = np.sqrt(np.einsum("...d,...d->...", gap, gap))
    odd = ~((plain > 1e-140) & (plain < 1e140))
    if odd.any():
        most = np.abs(gap[odd]).max(-1, keepdims=True)
        part = gap[odd] / np.where(most > 0, most, 1.0)
        plain[odd] = most[..., 0] * np.sqrt(np.einsum("...d,...d->...", part, part))
    return plain


def _nodes(vectors: DataFrame, k: int) -> DataFrame:
    """(dim, h1, h2, vec, ids): one row per distinct vector, with the ``k + 1`` least ids of its copies.

    A query's nearest ``k`` rows never hold more than these of one vector. The least ids are taken
    in two steps, so that no task gets more of a very common vector than the root of all rows.
    """
    salts = max(1, math.ceil(math.sqrt(vectors.count()) / 5))
    keyed = vectors.withColumns({"dim": F.size("vec"), "h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(5), "vec")})
    # rows equal in id and vector are one
    keyed = keyed.groupBy("dim", "h1", "h2", "vec_id").agg(F.min("vec").alias("vec")).withColumn("salt", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(salts)))
    some = keyed.withColumn("turn", F.row_number().over(Window.partitionBy("dim", "h1", "h2", "salt").orderBy("vec_id"))).where(F.col("turn") <= k + 1)
    few = some.withColumn("turn", F.row_number().over(Window.partitionBy("dim", "h1", "h2").orderBy("vec_id"))).where(F.col("turn") <= k + 1)
    return few.groupBy("dim", "h1", "h2").agg(F.min_by("vec", "vec_id").alias("vec"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part: an id, and a vector that is not null, zero or partly null or not finite."""
    # adding 0.0 makes -0.0 and 0.0 the same component
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0)).alias("vec"))
    finite = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return clean.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("vec", lambda v: v != 0), F.lit(False)))


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS, k: int = K) -> DataFrame:
    """(dim, shard, node, vec, ids, edges, start) of every distinct vector of ``vectors(vec_id, vec)``, written once."""
    nodes = materialise(_nodes(vectors, k), "nodes")
    sizes = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    shards = F.lit(1)
    for dim, n in sizes.items():
        shards = F.when(F.col("dim") == dim, math.ceil(n / shard_rows)).otherwise(shards)
    dealt = nodes.withColumn("shard", F.pmod("h1", shards).cast("int")).select("dim", "shard", "h1", "h2", "vec", "ids")

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.lexsort((rows["h2"].to_numpy(), rows["h1"].to_numpy()))))
        dim = rows["dim"][0].as_py()
        exact = _matrix(rows["vec"], dim)
        edges, start = build_graph(View.of(exact)(exact))
        size = (edges >= 0).sum(1)
        links = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(edges[edges >= 0].astype(np.int32)))
        n = len(edges)
        return pa.table({"dim": rows["dim"], "shard": rows["shard"], "node": pa.array(np.arange(n, dtype=np.int32)), "vec": rows["vec"], "ids": rows["ids"], "edges": links, "start": pa.array(np.full(n, start, np.int32))})

    schema = "dim int, shard int, node int, vec array<double>, ids array<bigint>, edges array<int>, start int"
    return materialise(dealt.groupBy("dim", "shard").applyInArrow(build, schema), "graph")


def search_index(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of the index for each ``(vec_id, vec)`` of ``queries``."""
    total = queries.count()
    blocks = max(1, math.ceil(total / block))
    shards = index.select(F.col("dim").alias("qdim"), F.col("shard").alias("qshard")).distinct()
    asked = queries.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    asked = asked.join(shards, F.col("dim") == F.col("qdim")).select("qdim", "qshard", "block", "query_id", "q")
    every = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(nodes: pa.Table, wanted: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if nodes.num_rows and wanted.num_rows:
            nodes = nodes.sort_by("node")
            dim = nodes["dim"][0].as_py()
            exact, points = _matrix(nodes["vec"], dim), _matrix(wanted["q"], dim)
            lists, ids, query = nodes["edges"].combine_chunks(), nodes["ids"].to_pylist(), wanted["query_id"].to_numpy()
            size = lists.value_lengths().to_numpy().astype(np.int64)
            edges = np.full((len(exact), max(int(size.max(initial=1)), 1)), -1, np.int64)
            edges[np.arange(edges.shape[1])[None, :] < size[:, None]] = lists.flatten().to_numpy()
            view, start = View.of(exact), nodes["start"][0].as_py()
            x = view(exact)
            for at in range(0, len(points), BATCH):
                some = points[at : at + BATCH]
                found, _ = beam_search(x, edges, start, view(some), max(beam, 2 * k))
                away = distances(exact[np.maximum(found, 0)] - some[:, None, :])
                for b in range(len(some)):
                    own, best, met = int(query[at + b]), [], set()
                    near = found[b] >= 0
                    for away_c, node in sorted(zip(away[b][near].tolist(), found[b][near].tolist(), strict=True)):
                        if len(best) >= k and away_c > best[k - 1][0]:
                            break
                        fresh = [i for i in ids[node] if i != own and i not in met]
                        met.update(fresh)
                        best += [(away_c, i) for i in fresh]
                        best.sort()
                    for score, i in best[:k]:
                        out["query_id"].append(own), out["vec_id"].append(i), out["score"].append(score)
        return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    found = every.groupBy("dim", "shard", "block").cogroup(asked.groupBy("qdim", "qshard", "block")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's ``k`` nearest other rows of ``vectors(vec_id, embedding)``.

    Euclidean distance; ties go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do rows without an id; vectors of different lengths are
    never neighbours. Copies are neighbours like any others. Rows that share an id are one item: as a
    query it asks with each of its vectors, as an answer it is listed once, at its nearest; it is never
    its own neighbour. Extra columns are ignored; where there are fewer candidates than ``k``, all found
    are returned. An empty table gives an empty result.
    """
    good = usable(vectors)
    index = build_index(good, shard_rows, k)
    return search_index(index, usable(vectors.where(is_query)).dropDuplicates(["vec_id", "vec"]), k, beam)
