"""Language identification by language-bitmask n-gram filters.

A Bloom filter whose slots hold one bit per language, in as many 64-bit words as the languages need,
answers, with a few look-ups, which languages contain an n-gram: the AND of the n-gram's slots is the
set of these languages. A text's n-grams vote by popcount per language; a language's count is corrected for the false positives that its
filter's fill predicts, and the largest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.storage import materialise
from tideline.llm.textops import mix, slices, tidied

#: Bytes of an n-gram, slots of the filter (a power of two), look-ups per n-gram.
NGRAM, SLOTS, PROBES = 4, 1 << 20, 3
#: Texts that the filters learn from at most, in expectation, per language.
SAMPLE_ROWS = 2000
#: An n-gram belongs to the languages that hold this share of its relative frequency, seen this often.
SHARE, SEEN = 0.3, 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# n-grams run over letters (and bytes of other alphabets); all else is one blank
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id's decimal text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams (blanks folded, A-Z lower-cased) and their documents, in order."""
    text = _LOWER[data]
    keep = np.ones(len(text), bool)
    if len(text) > 1:
        keep[1:] = (text[1:] != 32) | (text[:-1] != 32)
        keep[offsets[:-1][offsets[:-1] < len(text)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    text, bounds = text[keep].astype(np.uint32), kept[offsets]
    n = len(text) - NGRAM + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.zeros(len(offsets), np.int64)
    gram = text[:n].copy()
    for k in range(1, NGRAM):
        gram = (gram << np.uint32(8)) | text[k : k + n]
    # starts of documents' n-grams: the last NGRAM - 1 places of a document start none
    place = np.ones(n, bool)
    for k in range(1, NGRAM):
        at = bounds[1:] - k
        place[at[(at >= 0) & (at < n)]] = False
    before = np.concatenate([[0], np.cumsum(place)])
    return gram[place], before[np.minimum(bounds, n)]


def _probes(grams: np.ndarray) -> Iterator[np.ndarray]:
    h = mix(grams.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((h + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64)


@dataclass(frozen=True)
class LanguageFilters:
    """Bit ``i % 64`` of word ``i // 64`` of a slot belongs to ``languages[i]``; ``slots`` has a row for each word."""

    languages: tuple[str, ...]
    slots: np.ndarray
    false_positive: np.ndarray

    @staticmethod
    def of(bits: dict[str, bytes]) -> LanguageFilters:
        """From each language's own filter, ``SLOTS`` packed bits."""
        languages = tuple(sorted(bits))
        slots = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)
        fill = np.zeros(len(languages))
        for i, lang in enumerate(languages):
            word, bit = divmod(i, 64)
            own = np.unpackbits(np.frombuffer(bits[lang], np.uint8)).astype(np.uint64)
            slots[word] |= own << np.uint64(bit)
            fill[i] = own.sum() / SLOTS
        return LanguageFilters(languages, slots, fill**PROBES)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's language index, or -1, and the score in 0 to 1."""
        grams, bounds = ngrams(data, offsets)
        probes = list(_probes(grams))
        n = np.diff(bounds).astype(np.float64)
        shares = np.zeros((len(self.languages), len(n)))
        for i in range(len(self.languages)):
            word, bit = divmod(i, 64)
            if not bit:
                slots = self.slots[word]
                mask = slots[probes[0]]
                for at in probes[1:]:
                    mask = mask & slots[at]
            hits = np.concatenate([[0], np.cumsum((mask >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
            found = np.diff(hits[bounds])
            shares[i] = np.maximum(found - n * self.false_positive[i], 0) / (1 - self.false_positive[i])
        if not len(self.languages):
            return np.full(len(n), -1), np.zeros(len(n))
        best, total = shares.argmax(0), shares.sum(0)
        score = np.divide(shares.max(0), total, out=np.full(len(n), 1.0 / len(self.languages)), where=total > 0)
        return best, np.clip(score, 0, 1)


def learn_filters(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageFilters:
    """Learns from rows of ``docs(doc_id, text, lang)`` that are not held out, a bounded sample per language.

    The sample is chosen by the hash of the id: ``sample_rows`` per language in expectation. Executors
    count its n-grams and fill each language's filter; only filters (``SLOTS`` bits each) come to the driver.
    """
    usable = docs.where(F.col("lang").isNotNull() & ~held_out())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    chance = F.least(F.lit(1.0), F.lit(float(sample_rows)) / F.col("n")) * (1 << 20)
    known = usable.where(F.col("text").isNotNull()).select("lang", "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)).alias("place"))
    chosen = known.join(F.broadcast(counts), "lang").where(F.col("place") < chance.cast("int")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(0).dictionary_encode()
            of_row, names = code.indices.to_numpy(), code.dictionary
            for row, data, offsets in slices(batch.column(1)):
                grams, bounds = ngrams(data, offsets)
                lang = np.repeat(of_row[row : row + len(offsets) - 1], np.diff(bounds)).astype(np.uint64)
                key, n = np.unique(lang << np.uint64(32) | grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([names.take(pa.array((key >> np.uint64(32)).astype(np.int64))), pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    seen = chosen.mapInArrow(tidied(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    seen = materialise(seen, "grams")
    totals = seen.groupBy("lang").agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    shares = seen.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    every = F.sum("share").over(Window.partitionBy("gram"))  # one row for each language that has the n-gram
    telling = shares.withColumn("every", every).where((F.col("n") >= F.least(F.lit(SEEN), F.col("most"))) & (F.col("share") >= SHARE * F.col("every")))

    def fill(rows: pa.Table) -> pa.Table:
        bits = np.zeros(SLOTS, np.uint8)
        for at in _probes(rows["gram"].to_numpy().astype(np.uint32)):
            bits[at] = 1
        return pa.table({"lang": rows["lang"].slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = telling.select("lang", "gram").groupBy("lang").applyInArrow(fill, "lang string, bits binary")
    return LanguageFilters.of({r.lang: bytes(r.bits) for r in found.collect()})


def identify(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs(doc_id, text)``.

    ``und`` with score 0 for a null text or one without letters (and where no language was learned).
    Of languages with equal counts the first by name wins; a text whose n-grams are all unknown thus
    gets the first language, with an even score. Whole texts count, however long; repeated rows are judged alike; extra columns are ignored; no rows give no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for row, data, offsets in slices(batch.column(1)):
                best, score = model.score(data, offsets)
                has = letters[row : row + len(best)] & (best >= 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(best)), pa.array(names[np.where(has, best, len(names) - 1)], pa.string()), pa.array(np.where(has, score, 0.0))], names=schema.names)

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", has_letter.alias("letters")).mapInArrow(judge, schema)
