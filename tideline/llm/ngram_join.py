"""N-gram Jaccard self-join: rare-first prefixes, length, positional and suffix filters, one check per pair.

A document is the set of its distinct five-word shingles; two link when
``100 * |A and B| >= 75 * |A or B|``. The steps:

1. One pass over the texts gives each document's set size and digest, and the frequency sketch: how
   often shingles fall into each of a fixed number of cells. Equal sets are one class, which is
   represented by its smallest ``doc_id``.
2. A second pass orders each set rare-first (by cell count, then hash) and takes its prefix of
   ``n - ceil(0.75 n) + 1`` shingles with their positions. Sets that link share a prefix shingle.
   Postings travel in compressed blocks, one for each bucket of shingles and run of a task; a bucket
   gives the lists of the shingles that two documents or more hold. Of a class only its
   representative is posted, however many tasks its copies lie in.
3. Each member of a list is paired with the list's most central document (the one with the fewest
   rarer shingles before the shared one): a number of pairs linear in the lists. Pairs that fail the
   length or the positional filter are left out, the rest are made distinct, thinned by the suffix
   filter (histograms of the sets) and checked once on the whole texts.
4. Components of these links; then, exhaustively, the pairs of a list whose members are in
   different components (the same filters, the same one check), each at its first shared shingles.
   Pairs within a component cannot change it, which is why copies never expand into all pairs and
   yet no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.cells import CELLS, Counter, ranks, squeezed
from tideline.llm.components import HUBS, connected_components, hub_join, least_join
from tideline.llm.storage import materialise
from tideline.llm.textops import mix, shingle_sets, tidied

#: Words of a shingle, and the least similarity in hundredths.
WIDTH, LEAST = 5, 75
#: Postings that a task sorts at once, and prefix postings of a bucket on average.
RUN, BUCKET_ROWS = 1 << 20, 1 << 18
#: Pairs whose sets are held at once.
PAIRS = 256
#: Bins of the histograms that the suffix filter compares.
BINS = 128
#: Shingles before the shared one by which the exhaustive step tells that a pair met before.
HEAD = 8
#: Most ids (or pairs of ids) that are broadcast to pick the texts to check; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SCAN = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n", "c1", "c2")] + [T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])
_BLOCK = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("block", T.BinaryType())])
_LISTED = "sh bigint, doc_id bigint, n bigint, pos bigint, hub bigint, cn bigint, cpos bigint"
_BINS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bins", T.ArrayType(T.ShortType()))])


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share, as two signed longs."""
    one, two = mix(s), mix(s ^ np.uint64(0xA0761D6478BD642F))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


def _scan(docs: DataFrame, width: int) -> DataFrame:
    """Sizes and digests of all documents (chunk null), and the task's cell counts (chunk not null)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Counter()
        for batch in batches:
            n, c1, c2 = [], [], []
            for s in shingle_sets(batch.column(1), width):
                a, b = digest(s)
                n.append(len(s)), c1.append(a), c2.append(b), cells.add(s)
            none = pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), *none], names=_SCAN.names)
        chunks = list(cells.chunks())
        none = pa.nulls(len(chunks), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array([k for k, _ in chunks], pa.int32()), pa.array([c for _, c in chunks], pa.binary())], names=_SCAN.names)

    return docs.select("doc_id", "text").mapInArrow(tidied(scan), _SCAN)


def prefix_length(n: int, least: int = LEAST) -> int:
    return n - -(-least * n // 100) + 1


def _blocks(parts: list[tuple[int, int, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """One block per bucket from documents' prefixes (doc, n, shingles in their order)."""
    if not parts:
        return
    size = np.array([len(s) for _, _, s in parts])
    sh = np.concatenate([s for _, _, s in parts])
    owner = np.repeat(np.arange(len(parts), dtype=np.uint32), size)
    pos = (np.arange(len(sh)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint32)
    order = np.lexsort((sh, bucket := sh % np.uint64(buckets)))
    sh, owner, pos, bucket = sh[order], owner[order], pos[order], bucket[order]
    doc, n = np.array([d for d, _, _ in parts], np.int64), np.array([m for _, m, _ in parts], np.int64)
    cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    out = []
    for k in np.flatnonzero(np.diff(cut)).tolist():
        z = slice(cut[k], cut[k + 1])
        used, local = np.unique(owner[z], return_inverse=True)
        steps = np.diff(sh[z], prepend=np.uint64(0))
        head = np.array([len(used), z.stop - z.start], np.int64).tobytes()
        raw = squeezed([doc[used], n[used], steps, local.astype(np.uint32), pos[z]])
        out.append({"bucket": k, "block": head + raw})
    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("bucket", pa.int32()), ("block", pa.binary())]))


def _opened(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, doc, n, pos) of a block of ``_blocks``."""
    docs, rows = np.frombuffer(block[:16], np.int64).tolist()
    kinds = ((docs, np.int64), (docs, np.int64), (rows, np.uint64), (rows, np.uint32), (rows, np.uint32))
    total = sum(n * np.dtype(k).itemsize for n, k in kinds)
    raw = np.frombuffer(pa.decompress(block[16:], total, codec="zstd", asbytes=True), np.uint8)
    columns, at = [], 0
    for n, kind in kinds:
        wide = np.dtype(kind).itemsize
        columns.append(np.ascontiguousarray(raw[at : at + n * wide].reshape(wide, n).T).view(kind).ravel())
        at += n * wide
    doc, size, steps, local, pos = columns
    return np.cumsum(steps, dtype=np.uint64), doc[local], size[local], pos.astype(np.int64)


def _lists(docs: DataFrame, cells: object, buckets: int, width: int, least: int) -> DataFrame:
    """Every posting of a shingle that two documents or more hold in their prefixes, with its list's central one."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, held = cells.value, set(), 0
        parts: list[tuple[int, int, np.ndarray]] = []
        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
                if doc is None or not len(s) or (key := digest(s)) in seen:
                    continue
                seen.add(key)
                count = counts[(s % np.uint64(CELLS)).astype(np.int64)]
                p = prefix_length(len(s), least)
                some = np.flatnonzero(count <= np.partition(count, p - 1)[p - 1])
                parts.append((doc, len(s), s[some[np.lexsort((s[some], count[some]))[:p]]]))
                held += p
                if held > RUN:
                    yield from _blocks(parts, buckets)
                    parts, held = [], 0
        yield from _blocks(parts, buckets)

    def gather(blocks: pa.Table) -> pa.Table:
        sh, doc, n, pos = (np.concatenate(x) for x in zip(*[_opened(b) for b in blocks["block"].to_pylist()], strict=True))
        order = np.argsort(sh, kind="stable")
        near = sh[order][1:] == sh[order][:-1]
        keep = order[np.append(near, False) | np.insert(near, 0, False)]
        keep = keep[np.lexsort((doc[keep], n[keep], pos[keep], sh[keep]))]
        sh, doc, n, pos = sh[keep], doc[keep], n[keep], pos[keep]
        first = np.flatnonzero(np.append(True, sh[1:] != sh[:-1])[: len(sh)])
        hub = np.repeat(first, np.diff(np.append(first, len(sh))))
        return pa.table([*map(pa.array, (sh.view(np.int64), doc, n, pos, doc[hub], n[hub], pos[hub]))], names=["sh", "doc_id", "n", "pos", "hub", "cn", "cpos"])

    posted = docs.select("doc_id", "text").mapInArrow(tidied(post), _BLOCK)
    return posted.groupBy("bucket").applyInArrow(gather, _LISTED)


def _class_lists(docs: DataFrame, copies: DataFrame, several: DataFrame, cells: object, buckets: int, width: int, least: int) -> DataFrame:
    """``_lists`` without the documents that ``copies(u, v)`` link to an equal set of a smaller id.

    Those in ``several`` hold more than one text and stay.
    """
    equal = materialise(copies.where("u != v").select(F.col("u").alias("doc_id")).distinct().join(several, "doc_id", "left_anti"), "equal")
    if equal.count() <= BROADCAST_IDS:
        return _lists(docs.join(F.broadcast(equal), "doc_id", "left_anti"), cells, buckets, width, least)
    # the narrow postings are shuffled, not the texts
    return _lists(docs, cells, buckets, width, least).join(equal, "doc_id", "left_anti")


def _may_link(a: str, b: str, least: int) -> str:
    """Length and positional filters on sides ``a`` and ``b``, as SQL over columns n and pos."""
    n, m, p, q = f"{a}n", f"{b}n", f"{a}pos", f"{b}pos"
    return f"100 * least({n}, {m}) >= {least} * greatest({n}, {m}) AND {100 + least} * least({n} - {p}, {m} - {q}) >= {least} * ({n} + {m})"


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _histograms(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """Set sizes and histograms of the documents whose ids are in ``needed``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, size = np.empty((batch.num_rows, BINS), np.int16), np.empty(batch.num_rows, np.int64)
            for i, s in enumerate(shingle_sets(batch.column(1), width)):
                bins[i], size[i] = np.bincount((s >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS).clip(max=32767), len(s)
            flat = pa.ListArray.from_arrays(np.arange(0, bins.size + 1, BINS, dtype=np.int32), bins.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), flat], names=_BINS.names)

    return docs.select("doc_id", "text").join(_few(needed), "doc_id", "left_semi").mapInArrow(tidied(build), _BINS)


def _check(docs: DataFrame, pairs: DataFrame, width: int, least: int) -> DataFrame:
    """The pairs (u, v) of ``pairs(a, b)`` that link: suffix filter on histograms, then one check on whole texts."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bins = materialise(_histograms(docs, needed, width), "bins")
    total = pairs.count()
    left = bins.select(F.col("doc_id").alias("a"), F.col("n").alias("an"), F.col("bins").alias("abins"))
    right = bins.select(F.col("doc_id").alias("b"), F.col("n").alias("bn"), F.col("bins").alias("bbins"))
    apart = F.expr("aggregate(zip_with(abins, bbins, (x, y) -> abs(int(x) - int(y))), 0, (s, x) -> s + x)")
    # |A xor B| >= the sum over bins of the differences of their counts (clipped counts only lessen it)
    near = hub_join(hub_join(pairs, left, "a", "b", total), right, "b", "a", total)
    thin = materialise(near.where((100 + least) * apart <= (100 - least) * (F.col("an") + F.col("bn"))).select("a", "b").distinct(), "thin")
    one = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("x")).join(_few(thin), "a")
    two = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("y")).join(_few(thin.select("b").distinct()), "b", "left_semi")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                # texts that meet several others are cut into shingles once
                known = []
                for text in (batch.column(2), batch.column(3)):
                    code = text.dictionary_encode()
                    sets = list(shingle_sets(code.dictionary, width))
                    known.append([sets[i] if i is not None else np.empty(0, np.uint64) for i in code.indices.to_pylist()])
                linked = []
                for x, y in zip(*known, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked.append(len(x) > 0 and (100 + least) * both >= least * (len(x) + len(y)))
                yield batch.select([0, 1]).filter(pa.array(linked))

    return hub_join(one, two, "b", "a", thin.count(), keys=thin).select("a", "b", "x", "y").mapInArrow(tidied(verify), "a bigint, b bigint").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _between(rest: DataFrame, several: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) of a list's members in different components.

    A pair that has met at an earlier shingle (one of the first ``HEAD`` of both, in the one order of
    all shingles) is not made again: at the first shared one it passes every filter if it links.
    Documents in ``several`` hold more than one text, so their shingles have no one order; they do
    without this.
    """
    of_doc = Window.partitionBy("doc_id").orderBy("pos", "sh")
    rest = rest.withColumn("turn", F.row_number().over(of_doc))
    whole = of_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = rest.withColumn("head", F.collect_list(F.when(F.col("turn") <= HEAD, F.col("sh"))).over(whole))
    rest = rest.join(several.withColumn("many", F.lit(True)), "doc_id", "left")
    before = F.when(F.col("many").isNull(), F.slice("head", F.lit(1), F.least(F.col("turn") - 1, F.lit(HEAD)))).otherwise(F.array().cast("array<bigint>"))
    sides = rest.select("sh", "doc_id", "n", "pos", "component", before.alias("before"))
    left, right = (sides.select(*[F.col(c).alias(f"{side}{c}") for c in sides.columns]) for side in ("l", "r"))
    apart = (F.col("lcomponent") != F.col("rcomponent")) & (F.col("ldoc_id") < F.col("rdoc_id")) & F.expr(_may_link("l", "r", least)) & ~F.arrays_overlap("lbefore", "rbefore")
    return left.join(right, (F.col("lsh") == F.col("rsh")) & apart).select(F.col("ldoc_id").alias("a"), F.col("rdoc_id").alias("b")).distinct()


def ngram_components(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id): each document's set size and the least id it reaches by links.

    ``docs`` has ``doc_id`` and ``text``; further columns are ignored. One row comes back per row.
    Null and empty texts have the empty set and link with nothing. Rows that share a ``doc_id`` are
    one node with all their texts. A null ``doc_id`` takes no part: its component is null. Whole
    texts are used, however long; equal texts and ties give the same class. An empty table gives an
    empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialise(_scan(docs, width), "scan")
    shared = docs.sparkSession.sparkContext.broadcast(ranks(scanned.where("chunk is not null").select("chunk", "counts")))
    slim = scanned.where("chunk is null").select("doc_id", F.col("n").alias("n_shingles"), "c1", "c2")
    members = slim.where("n_shingles > 0 and doc_id is not null")
    classes = members.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    rows, total = slim.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    large = max(1000, rows // HUBS)
    copies = materialise(least_join(members, classes, ["c1", "c2", "n_shingles"], "copies", rows, large).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "copies")
    several = slim.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")

    buckets = max(1, -(-total * (100 - least) // 100 // BUCKET_ROWS))
    listed = materialise(_class_lists(docs, copies, several, shared, buckets, width, least), "lists")

    stars = listed.where("doc_id != hub").where(F.expr(_may_link("", "c", least))).select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    links = materialise(_check(docs, materialise(stars, "stars"), width, least).union(copies), "links")
    groups = materialise(connected_components(links), "groups")

    known = listed.select("sh", "doc_id", "n", "pos").join(_few(groups.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("sh", "doc_id", "n", "pos", F.coalesce("component", "doc_id").alias("component"))
    known = materialise(known, "known")
    mixed = known.groupBy("sh").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("sh")
    found = materialise(_check(docs, materialise(_between(known.join(mixed, "sh", "left_semi"), several, least), "pairs"), width, least), "found")
    final = connected_components(links.union(found))
    return slim.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def near_duplicates_removed(docs: DataFrame, width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """One document of each component (its least ``doc_id``), with all columns; rows without an id stay.

    Rows that share a ``doc_id`` are one document: that of the least hash stays. Null and empty texts
    are linked with nothing and stay; an empty table gives an empty result.
    """
    groups = ngram_components(docs, width, least).where("doc_id = component_id").select("doc_id").distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = docs.where("doc_id is not null").join(groups, "doc_id", "left_semi").select("doc_id", F.struct(*columns).alias("row"), F.xxhash64(*columns).alias("h"))
    first = kept.groupBy("doc_id").agg(F.min_by("row", "h").alias("row")).select("row.*")
    return first.union(docs.where("doc_id is null").select(*columns))
