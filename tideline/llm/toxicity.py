"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the hashed vectors of its character n-grams and of itself, a text's
vector is the mean of its words', and a linear softmax over it gives the text's class. Embeddings
and softmax are trained jointly in NumPy on a bounded sample of labelled texts, which executors turn
into bags of buckets and one task trains on; neither texts nor bags pass through the driver. Unseen
misspellings share n-gram vectors with the words that they vary.

A text's mean alone dilutes a few telling words among many. So the calibration, a logistic
regression on texts of the sample that training does not see, takes two inputs: the text's logit and
that of its most toxic word, the text that this word would make alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.langid import held_out
from tideline.llm.storage import materialise
from tideline.llm.textops import Words, mix, slices, tidied

#: Hashed vectors, their length, and n-gram sizes in bytes of ``<word>``.
BUCKETS, DIM, SIZES = 1 << 17, 8, (3, 4, 5)
#: Labelled texts of each class that training sees at most, and entries (8 bytes) of their bags.
SAMPLE_ROWS, SAMPLE_ENTRIES = 2000, 1 << 23
#: A text is called toxic from this score on.
THRESHOLD = 0.3
#: Training steps, texts of a step, step sizes of embeddings and softmax, and the share of texts that calibrate.
STEPS, BATCH, RATE, SOFT_RATE, ASIDE = 400, 64, 0.4, 0.3, 0.2


def subwords(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the words ``which``, and each word's bounds in them.

    The n-grams of ``<word>`` of all ``SIZES``, and the whole of it.
    """
    starts, lengths = words.starts[which], words.ends[which] - words.starts[which]
    wide = lengths + 2
    end = np.cumsum(wide)
    first = end - wide
    n = int(end[-1]) if len(end) else 0
    text = np.empty(n, np.uint8)
    text[first], text[end - 1] = ord("<"), ord(">")
    inner = np.repeat(starts - first - 1, wide) + np.arange(n)
    body = np.ones(n, bool)
    body[first] = body[end - 1] = False
    text[body] = words.data[inner[body]]
    left = np.repeat(end, wide) - np.arange(n)  # bytes from here to the word's end
    owner = np.repeat(np.arange(len(which)), wide)
    grams, owners = [], []
    rolled = np.zeros(n, np.uint64)
    for k in range(max(SIZES)):
        more = np.zeros(n, np.uint64)
        more[: n - k] = text[k:]
        rolled = rolled * np.uint64(0x100000001B3) + more + np.uint64(1)
        if k + 1 in SIZES:
            at = np.flatnonzero(left > k)
            grams.append(mix(rolled[at] + np.uint64((k + 1) << 56)))
            owners.append(owner[at])
    grams.append(mix(words.hashes()[which] ^ np.uint64(0x5851F42D4C957F2D)))
    owners.append(np.arange(len(which)))
    gram, own = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return (gram[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.searchsorted(own[order], np.arange(len(which) + 1))


def _slots(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first[i]`` to ``first[i] + count[i] - 1`` of all ``i`` in turn."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct buckets and their weights in its mean: ``BUCKETS`` entries at most, however long it is."""
    for _, data, offsets in slices(column):
        words = Words(data, offsets, lower=True)
        _, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        grams, bounds = subwords(words, at)
        size = np.diff(bounds)
        for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            word, times = np.unique(inverse[first:last], return_counts=True)
            entry = grams[_slots(bounds[word], size[word])]
            bucket, place = np.unique(entry, return_inverse=True)
            share = np.repeat(times / (size[word] * max(last - first, 1)), size[word])
            yield bucket.astype("<i4"), np.bincount(place, share, len(bucket)).astype("<f4")


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: the logit that each bucket adds, a bias, and the calibration of (text, most toxic word)."""

    logit: np.ndarray
    bias: float
    slopes: tuple[float, float]
    offset: float

    @staticmethod
    def constant(share: float) -> ToxicityModel:
        """Where there is nothing to learn from: every text gets the share of label 1, within 0.02 and 0.98."""
        share = min(max(share, 0.02), 0.98)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), 0.0, (0.0, 0.0), math.log(share / (1 - share)))

    def inputs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's logit and that of its most toxic word (2 columns), and its number of words."""
        words = Words(data, offsets, lower=True)
        n = len(offsets) - 1
        if not len(words):
            return np.zeros((n, 2)), words.counts
        _, at, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        grams, bounds = subwords(words, at)
        per_word = (np.add.reduceat(self.logit[grams].astype(np.float64), bounds[:-1]) / np.diff(bounds))[inverse]
        most = np.full(n, -np.inf)
        np.maximum.at(most, words.doc, per_word)
        mean = np.bincount(words.doc, per_word, n) / np.maximum(words.counts, 1)
        return np.stack([mean, np.where(words.counts > 0, most, 0.0)], 1) + self.bias, words.counts

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, words = self.inputs(data, offsets)
        z = np.where(words > 0, x @ np.array(self.slopes) + self.offset, -30.0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Embeddings and softmax trained jointly on ``bags`` of texts: the logit that each bucket adds, and the bias."""
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.05, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    squares = np.full((BUCKETS, DIM), 1e-10, np.float32)
    soft_squares, bias_squares = np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    toxic = max(float(label.mean()), 1e-9)
    even = np.where(label == 1, 0.5 / toxic, 0.5 / max(1 - toxic, 1e-9)).astype(np.float32)
    order = np.empty(0, np.int64)
    for _ in range(STEPS):
        if not len(order):
            order = rng.permutation(len(label))
        step, order = order[:BATCH], order[BATCH:]
        bucket, weight = (np.concatenate([texts[i][j] for i in step]) for j in (0, 1))
        text = np.repeat(np.arange(len(step)), [len(texts[i][0]) for i in step])
        hidden = np.stack([np.bincount(text, embed[bucket, d] * weight, len(step)) for d in range(DIM)], 1).astype(np.float32)
        z = hidden @ soft + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(step)), label[step]] -= 1
        error = p * even[step][:, None] / len(step)
        back = error @ soft.T
        for d in range(DIM):
            slope = np.bincount(bucket, weight * back[text, d], BUCKETS).astype(np.float32)
            squares[:, d] += slope * slope
            embed[:, d] -= RATE * slope / np.sqrt(squares[:, d])
        turn, lift = hidden.T @ error, error.sum(0)
        soft_squares += turn**2
        bias_squares += lift**2
        soft -= SOFT_RATE * turn / np.sqrt(soft_squares)
        bias -= SOFT_RATE * lift / np.sqrt(bias_squares)
    # buckets that no text of the sample has keep a small random vector, which says nothing
    seen = np.zeros(BUCKETS, bool)
    for bucket, _ in texts:
        seen[bucket] = True
    return np.where(seen, embed @ (soft[:, 1] - soft[:, 0]), 0).astype(np.float32), float(bias[1] - bias[0])


def calibrated(model: ToxicityModel, x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """``model`` with a weighted logistic regression of labels on its two inputs (Newton steps, mild ridge)."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], 1)
    theta = np.zeros(3)
    ridge = np.diag([5e-4, 5e-4, 1e-6]) * weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        grad = z.T @ (weight * (p - label)) + ridge @ theta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(3), grad)
        theta = theta - np.clip(step, -2, 2)
    slopes = theta[:2] / scale
    return replace(model, slopes=(float(slopes[0]), float(slopes[1])), offset=float(theta[2] - slopes @ centre))


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, place, aside, text) of at most ``rows`` texts of each class, written once, and the classes' sizes."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ranked = known.withColumn("place", F.xxhash64("doc_id", F.lit(6)))
    some = [ranked.where(F.col("toxic") == kind).orderBy("place", "doc_id").limit(rows) for kind in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # 2 * rows at most
    aside = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1000)) < int(1000 * ASIDE)
    found = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").groupBy("doc_id", "toxic", "place").agg(F.min("text").alias("text"))
    return materialise(found.withColumn("aside", aside), "toxic-sample"), counts


def _trained(sample: DataFrame, entries: int) -> tuple[np.ndarray, float] | None:
    """Trains in one task on the bags of the sample's texts that are not set aside; None where a class has none."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(bags(batch.column(2)))
            raw = [pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1)]
            size = pa.array([len(x[0]) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size, *raw], names=["toxic", "place", "size", "buckets", "weights"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, label = [], []
        for batch in batches:
            label += batch.column(0).to_pylist()
            texts += [(np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(w.as_buffer(), "<f4")) for b, w in zip(batch.column(1), batch.column(2), strict=True)]
        if len(set(label)) == 2:
            logit, bias = train(texts, np.array(label))
            yield pa.RecordBatch.from_arrays([pa.array([logit.tobytes()], pa.binary()), pa.array([bias])], names=["logit", "bias"])

    bagged = sample.where("not aside").select("toxic", "place", "text").mapInArrow(tidied(encode), "toxic int, place bigint, size bigint, buckets binary, weights binary")
    so_far = F.sum("size").over(Window.partitionBy("toxic").orderBy("place", "size"))  # at most the sample's rows
    bounded = bagged.where("size > 0").withColumn("so_far", so_far).where(F.col("so_far") <= entries // 2)
    # one task on purpose: its input is bounded by the sample's rows and entries
    row = bounded.repartition(1).sortWithinPartitions("place", "size").select("toxic", "buckets", "weights").mapInArrow(tidied(fit), "logit binary, bias double").first()
    return (np.frombuffer(row.logit, np.float32), row.bias) if row else None


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_entries: int = SAMPLE_ENTRIES) -> ToxicityModel:
    """Learns from ``labels(doc_id, toxic)`` of documents that are not held out, a bounded sample per class.

    Ids are chosen by hash from the labels, so only the sample's texts (``2 * sample_rows``) leave the
    table; of these, training takes as many as fit ``sample_entries`` entries of bags. An id with
    both labels counts as toxic; of an id's texts the least is taken. Null ids, labels and texts teach
    nothing. Without texts of both classes that have a word, the model gives the share of label 1.
    """
    sample, counts = _sample(docs, labels, sample_rows)
    share = counts.get(1, 0) / max(sum(counts.values()), 1)
    found = _trained(sample, sample_entries)
    if not found:
        return ToxicityModel.constant(share)
    model = ToxicityModel(*found, (1.0, 0.0), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(2)):
                x, words = shared.value.inputs(data, offsets)
                n = len(words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(words.astype(np.int64))], names=["toxic", "aside", "x", "y", "words"])

    judged = sample.select("toxic", "aside", "text").mapInArrow(tidied(judge), "toxic int, aside boolean, x double, y double, words bigint")
    rows = sorted((r.aside, r.toxic, r.x, r.y) for r in judged.where("words > 0").collect())  # 2 * sample_rows at most, four numbers each
    fit = [r for r in rows if r[0]]
    if len({r[1] for r in fit}) < 2:
        fit = rows
    label = np.array([r[1] for r in fit])
    weight = np.array([max(counts.get(k, 0), 1) / max(min(counts.get(k, 0), sample_rows), 1) for k in (0, 1)])[label]
    return calibrated(model, np.array([r[2:] for r in fit]), label, weight)


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row of ``docs(doc_id, text)``; whole texts count, however long.

    Null texts and texts without words score close to 0. Repeated rows score alike, extra columns
    are ignored, no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(1)):
                score = shared.value.score(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(score)), pa.array(score)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(tidied(judge), schema)


def toxic_removed(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns.

    Null, empty and wordless texts stay; whole texts count; repeated rows stay or go together; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(1)):
                clean = np.flatnonzero(shared.value.score(data, offsets) < threshold)
                if len(clean):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(clean + row))], names=["row"])

    return packed.mapInArrow(tidied(judge), T.StructType([packed.schema["row"]])).select("row.*")
