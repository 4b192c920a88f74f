"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source's target over its size is the number of copies that each of its documents should get,
a whole number and a fraction. Documents are dealt into blocks of a source by a hash; a block runs
through its documents once, largest first, and lets the fraction in hand and the next one exchange
mass, in words, in a random direction until one of the two is 0 or 1. Expected copies and the
block's expected words are kept exactly, and one fraction is left per block. These residuals meet
in blocks of the next level of a reduction tree, and at its root they meet the source's reserve, a
block that was kept back, whose smallest documents come last. What is left then is rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.storage import materialise

#: Documents of a block, on average, and residuals of a block of the tree.
BLOCK = 256
#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most copies of a document, in hundredths.
SHARE, MOST = 150, 200
#: Sources whose targets are broadcast at most; those of more are joined by a shuffle.
BROADCAST_SOURCES = 1_000_000
_CHUNK = 100_000

#: A word is ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> F.Column:
    """The number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _numbered(per: DataFrame) -> DataFrame:
    """``per`` with ``sid``: the place of each source in the order of code points, null last, from 1.

    Sources are sorted in ranges; the driver gets one count of each range.
    """
    order = F.asc_nulls_last("source")
    ranged = per.repartitionByRange(order).sortWithinPartitions(order)
    ranged = materialise(ranged.withColumns({"part": F.spark_partition_id(), "turn": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sources")
    before, at = {}, 0
    for row in ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():
        before[row.part], at = at, at + row.n
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.col("part").cast("long")) if before else F.lit(0)
    return ranged.withColumn("sid", (base + F.col("turn") + 1).cast("long")).drop("part", "turn")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, docs, target) from per-row (source, size, rows).

    Sources in the order of code points, null last, weigh ``weights`` in turn. Targets share
    ``share`` hundredths of all words by weight; a target stops at ``most`` hundredths of its
    source's words and the excess is shared among the others, again and again until none is above:
    each pass is one aggregate of whole numbers, so no task sees all sources and reruns agree.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("rows")).otherwise(0)).alias("docs"))
    place = (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")
    per = _numbered(per).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place))
    stop = F.col("source_size") * most
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:  # more sources stop with every pass that raises the level
        stops = stop <= level * F.col("weight")
        held, left = per.agg(F.coalesce(F.sum(F.when(stops, stop)), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0))).first()
        before, level = level, (total * share - held) / left if left else float("inf")
    target = F.least(stop.cast("double"), level * F.col("weight")) / 100
    return per.select("source", "sid", "source_size", "docs", target.alias("target"))


def _expanded(df: DataFrame) -> DataFrame:
    """One row per repeated row, numbered from 0 in ``idx``, made in bounded chunks."""
    steps = df.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("rows") - 1) / _CHUNK).cast("long"))))
    within = F.least(F.lit(_CHUNK), F.col("rows") - F.col("__step") * _CHUNK)
    rows = steps.withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), within - 1)))
    return rows.withColumn("idx", F.col("__step") * _CHUNK + F.col("__i")).drop("__step", "__i")


#: One exchange between the fraction in hand ``s.c`` and the next document ``e``. ``up`` words flow
#: to the one in hand with probability down / (up + down), else ``down`` words flow from it.
_STEP = """
(s, e) -> IF(s.c IS NULL, named_struct('c', e, 'out', s.out), transform(array(named_struct(
    'gain', (1 - s.c.x) * s.c.size, 'give', e.x * e.size, 'lose', s.c.x * s.c.size, 'take', (1 - e.x) * e.size,
    'r', pmod(xxhash64(s.c.h, e.h, {level}), 9007199254740992L) / 9007199254740992D)),
  m -> IF(m.r * (least(m.gain, m.give) + least(m.lose, m.take)) < least(m.lose, m.take),
    IF(m.gain <= m.give,
      named_struct('c', {e_less}, 'out', concat(s.out, array({c_one}))),
      named_struct('c', {c_more}, 'out', concat(s.out, array({e_zero})))),
    IF(m.lose <= m.take,
      named_struct('c', {e_more}, 'out', concat(s.out, array({c_zero}))),
      named_struct('c', {c_less}, 'out', concat(s.out, array({e_one}))))))[0])
"""


def _step(level: int) -> str:
    def moved(v: str, x: str) -> str:
        return f"named_struct('o', {v}.o, 'h', {v}.h, 'x', {x}, 'size', {v}.size, 'doc_id', {v}.doc_id, 'sid', {v}.sid, 'idx', {v}.idx)"

    def done(v: str, up: int) -> str:
        return f"named_struct('size', {v}.size, 'doc_id', {v}.doc_id, 'sid', {v}.sid, 'idx', {v}.idx, 'up', {up}L)"

    return _STEP.format(
        level=level,
        e_less=moved("e", "e.x - m.gain / e.size"), c_more=moved("s.c", "s.c.x + m.give / s.c.size"),
        e_more=moved("e", "e.x + m.lose / e.size"), c_less=moved("s.c", "s.c.x - m.take / s.c.size"),
        c_one=done("s.c", 1), c_zero=done("s.c", 0), e_one=done("e", 1), e_zero=done("e", 0),
    )


def _round_blocks(units: DataFrame, level: int, name: str) -> DataFrame:
    """(sid, block, r) with r.out the settled documents and r.c the residual of each block."""
    e = F.struct((-F.col("size")).alias("o"), "h", "x", "size", "doc_id", "sid", "idx").alias("e")
    lists = units.select("sid", "block", e).groupBy("sid", "block").agg(F.sort_array(F.collect_list("e")).alias("es"))
    e_type = lists.schema["es"].dataType.elementType.simpleString()
    start = f"named_struct('c', CAST(NULL AS {e_type}), 'out', CAST(array() AS array<struct<size:bigint,doc_id:bigint,sid:bigint,idx:bigint,up:bigint>>))"
    return materialise(lists.select("sid", "block", F.expr(f"aggregate(es, {start}, {_step(level)})").alias("r")), name)


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, rows, idx) for every row of ``docs``.

    ``docs`` has ``doc_id``, ``source`` and ``text``; the decision depends on these alone, so reruns
    agree. Rows equal in id, source and size are interchangeable and numbered by ``idx``. Null and
    empty texts have size 0 and no copies; null sources are one source, null ids are ids. Further
    columns are ignored. An empty table gives an empty result.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    grouped = materialise(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "sized")
    targets = materialise(source_targets(grouped, weights, share, most), "targets")
    per_copy = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    few = F.broadcast(targets) if targets.count() <= BROADCAST_SOURCES else targets
    known = grouped.alias("g").join(few.alias("t"), F.col("g.source").eqNullSafe(F.col("t.source"))).select(
        "doc_id", "size", "rows", "sid", "docs", F.floor(per_copy).alias("whole"), (per_copy - F.floor(per_copy)).alias("x"))
    units = _expanded(known.where("size > 0 and x > 0")).withColumn("h", F.xxhash64("doc_id", "sid", "size", "idx"))
    # block 0 of each source is its reserve for the root
    blocks = F.greatest(F.ceil(F.col("docs") / block), F.lit(1))
    units = units.withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), blocks)).select("sid", "block", "h", "x", "size", "doc_id", "idx")
    largest = (targets.agg(F.max("docs")).first()[0] or 0) // block + 1
    settled = []
    residual, level = None, 0
    leaves = units.where("block > 0")
    while largest > 1:
        done = _round_blocks(leaves if level == 0 else residual, level, f"level{level}")
        settled.append(done.select(F.explode("r.out").alias("d")).select("d.*"))
        residual = done.where("r.c is not null").select((F.floor((F.col("block") - 1) / block) + 1).alias("block"), "r.c.*").drop("o")
        largest, level = -(-largest // block), level + 1
    at_root = units.where("block = 0")
    if residual is not None:
        at_root = at_root.unionByName(residual.withColumn("block", F.lit(0).cast("long")).select(*at_root.columns))
    root = _round_blocks(at_root, level, "root")
    settled.append(root.select(F.explode("r.out").alias("d")).select("d.*"))
    settled.append(root.where("r.c is not null").select("r.c.size", "r.c.doc_id", "r.c.sid", "r.c.idx", F.when(F.col("r.c.x") >= 0.5, 1).otherwise(0).cast("long").alias("up")))
    ups = settled[0]
    for more in settled[1:]:
        ups = ups.unionByName(more)
    exact = _expanded(known.where("size = 0 or x = 0")).select("size", "doc_id", "sid", "idx", F.lit(0).cast("long").alias("up"))
    result = ups.unionByName(exact).join(few, "sid")
    return result.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") == 0, 0).otherwise(F.floor(per_copy) + F.col("up")).cast("long").alias("copies"), "idx")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: int = SHARE, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns.

    Of rows equal in id, source and size, those first by the hash of all their columns take the larger
    shares. Null and empty texts have no words and are never taken; null sources are one source, null
    ids are ids; whole texts count; an empty table gives an empty result. Rows that share a null id,
    source and size meet in one task.
    """
    decided = copies(docs, weights, share, most, block).groupBy("doc_id", "source", "size").agg(F.count("*").alias("__rows"), F.sum("copies").alias("__sum"))
    decided = decided.select(F.xxhash64("doc_id", "source", "size").alias("__key"), F.struct("doc_id", "source", "size").alias("__id"), "__rows", "__sum").where("__sum > 0")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    keyed = docs.select(row, own.alias("__own"), F.xxhash64("text", *[F.col(f"`{c}`") for c in docs.columns]).alias("__text"))
    keyed = keyed.withColumn("__key", F.xxhash64("__own.doc_id", "__own.source", "__own.size"))
    turn = F.row_number().over(Window.partitionBy("__key").orderBy("__text"))
    found = keyed.join(decided, "__key").where(F.col("__own").eqNullSafe(F.col("__id"))).withColumn("__turn", turn)
    times = F.floor(F.col("__sum") / F.col("__rows")) + F.when(F.col("__turn") <= F.col("__sum") % F.col("__rows"), 1).otherwise(0)
    return found.withColumn("__times", times.cast("int")).where("__times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("row.*")
