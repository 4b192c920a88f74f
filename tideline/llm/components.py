"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is an aggregation with map-side minima and a join; keys of very many rows (hubs) are
joined by a broadcast whose size is bounded, or in parts, so that no task gets all rows of a hub.
Each round's edges are written to the shared folder, and those of the round before deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.storage import discard, materialise

#: Rows of a key from which on it is a hub, at least (so many narrow rows are no burden), and hubs at most.
HUB_ROWS, HUBS = 10_000, 100_000


def hub_rows(total: int) -> int:
    """Rows of a key from which on it is a hub, in a table of ``total`` rows: at most ``HUBS`` keys have more."""
    return max(HUB_ROWS, total // HUBS)


def least_join(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int, most: int | None = None) -> DataFrame:
    """``rows`` joined with ``per_key``, an aggregate of rows with their ``count``: hubs by a broadcast, the rest by a shuffle."""
    most = most or hub_rows(total)
    hubs = F.broadcast(per_key.where(F.col(count) > most).drop(count))
    rest = rows.join(hubs, keys, "left_anti").join(per_key.where(F.col(count) <= most).drop(count), keys)
    return rows.join(hubs, keys).unionByName(rest)


def hub_join(rows: DataFrame, single: DataFrame, key: str, other: str, total: int, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``single`` (a row per ``key``, or few); rows of a hub are dealt into parts by ``other``.

    ``total``: of ``rows``. ``keys``: a table of the same keys in the same number that is cheaper to count.
    """
    most = hub_rows(total)
    hubs = (rows if keys is None else keys).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most)
    hubs = F.broadcast(hubs.select(key, F.ceil(F.col("n") / most).cast("int").alias("parts")))
    dealt = rows.join(hubs, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    copied = single.join(hubs, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(copied, [key, "part"]).drop("part")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, hubs: int) -> DataFrame:
    """Links every larger neighbour of a node to the least node among it and its neighbours.

    ``hubs``: the edges' number where some node is a hub, else 0.
    """
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    linked = least_join(both, least, ["u"], "n", 2 * hubs) if hubs else both.join(least, "u")
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame, hubs: int) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these; a node has no more of them than a large star found."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    linked = least_join(down, least, ["u"], "n", hubs) if hubs else down.join(least, "u")
    return linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its least node.

    Edges are undirected and may repeat; loops count as nodes. An empty table gives an empty result.
    """
    loops = edges.where("u = v").select("u", "v").distinct()
    now = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen or not mark.n:
            break
        seen, before = mark, now
        most = _both(now).groupBy("u").count().agg(F.max("count")).first()[0]
        hubs = mark.n if most > hub_rows(mark.n) else 0
        now = materialise(_small_star(_large_star(now, hubs).distinct(), hubs).distinct(), "edges")
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
