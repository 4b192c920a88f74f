"""Quality rules as a short-circuit cascade.

Each rule names the features that it needs and says which documents it rejects. The cascade
measures every rule's cost and rejection rate on a bounded sample, orders the rules by rejection
per cost, and evaluates a rule only on documents that no earlier rule has rejected. The order
changes the time spent, never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.textops import Words, mix, slices, span_hashes

#: Documents that the cascade times its rules on, in expectation.
SAMPLE_ROWS = 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_ALPHA = _UPPER.copy()
_ALPHA[ord("a") : ord("z") + 1] = True
_BANG = np.zeros(256, bool)
_BANG[ord("!")] = True


class Features:
    """Per-document features of some documents of a slice, each computed when first asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self._have = data, offsets, {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._have:
            self._have[name] = getattr(self, f"_{name}")()
        return self._have[name]

    def only(self, rows: np.ndarray) -> Features:
        """The same documents without those outside ``rows``; features known so far are kept."""
        lengths = np.diff(self.offsets)[rows]
        take = np.zeros(len(self), bool)
        take[rows] = True
        sub = Features(self.data[np.repeat(take, np.diff(self.offsets))], np.concatenate([[0], np.cumsum(lengths)]))
        sub._have = {k: v[rows] for k, v in self._have.items() if k[0] != "*"}
        return sub

    def _per_doc(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])

    def _words(self) -> Words:
        if "*words" not in self._have:
            self._have["*words"] = Words(self.data, self.offsets)
        return self._have["*words"]

    def _n_words(self) -> np.ndarray:
        return self._words().counts.astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        inside = np.ones(256, bool)
        inside[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
        return self._per_doc((inside & _STARTS_CHAR)[self.data])

    def _n_symbols(self) -> np.ndarray:
        return self._per_doc(_SYMBOL[self.data])

    def _n_upper(self) -> np.ndarray:
        return self._per_doc(_UPPER[self.data])

    def _n_alpha(self) -> np.ndarray:
        return self._per_doc(_ALPHA[self.data])

    def _n_bangs(self) -> np.ndarray:
        return self._per_doc(_BANG[self.data])

    def _n_repeat_words(self) -> np.ndarray:
        """Words in 3-word windows that the document holds twice or more, the first included."""
        words = self._words()
        out = np.zeros(len(self), np.int64)
        rolled, first = words.windows(words.hashes(), 3)
        if not len(first):
            return out
        doc = words.doc[first]
        key = mix(rolled ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        hits = first[counts[inverse] > 1]
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[hits + k] = True
        return np.bincount(words.doc[covered], minlength=len(self)).astype(np.int64)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """For each \\n-split line with a word: its document, and whether it equals an earlier one."""
        if "*lines" not in self._have:
            n = len(self.data)
            breaks = np.flatnonzero(self.data == 10)
            starts = np.unique(np.concatenate([self.offsets[:-1], breaks + 1]))
            starts = starts[starts < n]
            ends = np.append(starts[1:], n)
            # a line stops before its \n, or where its document stops
            ends = np.where(self.data[ends - 1] == 10, ends - 1, ends) if len(ends) else ends
            words = self._words()
            with_word = np.searchsorted(words.starts, starts) < np.searchsorted(words.starts, ends)
            starts, ends = starts[with_word], ends[with_word]
            doc = np.searchsorted(self.offsets, starts, "right") - 1
            key = span_hashes(self.data, starts, ends) ^ mix(doc.astype(np.uint64))
            _, first = np.unique(key, return_index=True)
            later = np.ones(len(starts), bool)
            later[first] = False
            self._have["*lines"] = doc, later
        return self._have["*lines"]

    def _n_lines(self) -> np.ndarray:
        return np.bincount(self._lines()[0], minlength=len(self)).astype(np.int64)

    def _n_dup_lines(self) -> np.ndarray:
        doc, later = self._lines()
        return np.bincount(doc[later], minlength=len(self)).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """Rejects the documents for which ``rejects(features)`` is true."""

    name: str
    rejects: Callable[[Features], np.ndarray]


#: What every kept document must pass, stated by the contract of the query.
BASE_RULES = (
    Rule("too_few_words", lambda f: f["n_words"] < 50),
    Rule("repeated_windows", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)

#: Further rules of the cascade.
METHOD_RULES = (
    Rule("symbols", lambda f: 100 * f["n_symbols"] > 7 * f["word_chars"]),
    Rule("shouting", lambda f: (2 * f["n_upper"] > f["n_alpha"]) & (f["n_alpha"] > 0)),
    Rule("exclamations", lambda f: 2 * f["n_bangs"] > f["n_words"]),
    Rule("word_length", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("duplicate_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def timed(column: pa.Array, rules: Sequence[Rule]) -> list[tuple[int, float]]:
    """For each rule the texts of ``column`` that it rejects, and the seconds it takes."""
    rejected, cost = [0] * len(rules), [0.0] * len(rules)
    for _, data, offsets in slices(column):
        for i, rule in enumerate(rules):
            features = Features(data, offsets)
            began = time.perf_counter()
            rejected[i] += int(np.count_nonzero(rule.rejects(features)))
            cost[i] += time.perf_counter() - began
    return list(zip(rejected, cost, strict=True))


def cascade(features: Features, rules: Sequence[Rule]) -> np.ndarray:
    """Indices of documents that no rule rejects; a rule sees only what those before it have left."""
    alive = np.arange(len(features))
    for rule in rules:
        if not len(alive):
            break
        stays = ~rule.rejects(features)
        if not stays.all():
            alive = alive[stays]
            features = features.only(np.flatnonzero(stays))
    return alive


def _ordered(docs: DataFrame, text_col: str, rules: Sequence[Rule], sample_rows: int) -> list[Rule]:
    """Rules by rejected documents per second, on ``sample_rows`` texts in expectation from all parts of the table.

    Executors time the rules; only counts and seconds come to the driver. The order changes no verdict.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    total = docs.count()
    share = int(min(sample_rows / max(total, 1), 1) * (1 << 40))
    chosen = rows.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("row"), F.lit(1 << 40)) < share)).select("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = timed(batch.column(0), rules)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array([r for r, _ in found], pa.int64()), pa.array([c for _, c in found], pa.float64())], names=["rule", "rejected", "cost"])

    sums = chosen.mapInArrow(measure, "rule int, rejected bigint, cost double").groupBy("rule").agg(F.sum("rejected").alias("rejected"), F.sum("cost").alias("cost"))
    worth = {r.rule: (r.rejected + 0.5) / (r.cost + 1e-9) for r in sums.collect()}
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth.get(i, 0))]


def quality_metrics(
    docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = METHOD_RULES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Every document's metrics and verdict, with the columns of ``carry``.

    A null or empty text has no words: all metrics are 0 and it fails the base rules. Repeated rows
    are judged one by one. An empty table gives an empty result. Of the columns that clash, the
    metric wins and the carried one is left out.
    """
    ordered = _ordered(docs, text_col, rules, sample_rows)
    carry = [c for c in carry if c not in (*METRICS, "base_failed", "kept")]
    schema = T.StructType(
        [docs.schema[c] for c in carry]
        + [T.StructField(m, T.LongType()) for m in METRICS]
        + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(len(carry))):
                features = Features(data, offsets)
                values = [features[m] for m in METRICS]
                failed = np.zeros(len(features), bool)
                for rule in BASE_RULES:
                    failed |= rule.rejects(features)
                kept = np.zeros(len(features), bool)
                passed = np.flatnonzero(~failed)
                if len(passed):
                    kept[passed[cascade(features.only(passed), ordered)]] = True
                rows = [batch.column(i).slice(row, len(features)) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([*rows, *map(pa.array, (*values, failed, kept))], names=schema.names)

    return docs.select(*carry, F.col(text_col).alias("__text")).mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] = (*BASE_RULES, *METHOD_RULES), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with all their columns; null texts are rejected.

    All rules, those of the base included, run in the measured order, so that the costly ones see
    few documents.
    """
    ordered = _ordered(docs, text_col, rules, sample_rows)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slices(batch.column(1)):
                alive = cascade(Features(data, offsets), ordered)
                if len(alive):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(alive + row))], names=["row"])

    kept = packed.mapInArrow(judge, T.StructType([packed.schema["row"]]))
    return kept.select("row.*")
