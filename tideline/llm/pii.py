"""Personal data: patterns for what has a fixed form, and a linear-chain conditional random field beside them.

The patterns give e-mail addresses, IP addresses, card and phone numbers. The field tags the words of a
text by word-shape features (the shape, the shape with runs drawn together, the word in lower case, and
marks around it, of the word and of two on each side) with a kind or none, so that it also finds
numbers that patterns miss beside other digits, spelled-out addresses, names and places of residence.
It is trained in NumPy by maximum likelihood on a small labelled table and decoded by Viterbi
over batches of whole texts. Words that are ``none`` by a margin larger than anything transitions could
outweigh are settled at once, which is exact; Viterbi runs between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.pii_table import KINDS, labelled_table
from tideline.llm.textops import _LOWER, Words, mix, slices, span_hashes, tidied

#: Labelled rows that training takes at most, passes over them, step size, and the penalty of weights.
TABLE_ROWS, STEPS, RATE, RIDGE = 5000, 80, 0.15, 2e-4
#: Words on each side whose features count, and words whose scores are held at once.
REACH, CHUNK = 2, 1 << 16
#: Kinds that have patterns; the others come from the field alone.
BASE = KINDS[:4]

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits is entered at its start only, so that long ones cost no more than their length
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]*[0-9]")
#: An address with its signs spelled out, in brackets or apart, and a name of two to four words.
_SPELLED = re.compile(r"[\w.+-]+ ?[\[(]?(?:at|@)[\])]? ?[\w-]+(?: ?[\[(]?(?:dot|\.)[\])]? ?[\w-]+)+", re.IGNORECASE)
_NAME = re.compile(r"[^\W\d_a-z][\w'-]+(?: (?:[^\W\d_a-z]\.|[^\W\d_a-z][\w'-]+)){1,3}")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    used = at = 0  # the end of the last address, and the place after the last @
    for m in _AT.finditer(text):
        seen = text.rfind("@", at, m.start())
        at = max(at, used, seen + 1)
        local = text[at : m.start()]
        start = at + len(local.rstrip(_LOCAL))
        if start < m.start():
            yield start, m.end()
            used = m.end()
        at = m.start() + 1


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost and not overlapping by kind; matches that fail their test are dropped."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if m.end() - m.start() >= 4 and 9 <= len(_digits(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- features

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1], _SHAPE[ord("a") : ord("z") + 1] = ord("X"), ord("x")
_SHAPE[ord("0") : ord("9") + 1], _SHAPE[128:] = ord("d"), ord("x")
_TAIL, _HEAD = np.zeros(256, bool), np.zeros(256, bool)
_TAIL[list(b".,;:!?\"'>%$#|&")] = True
_HEAD[list(b"\"'<$#|&")] = True
_TAGS = (np.uint64(0x1B56C4E9A1), np.uint64(0x2C57D1EB37), np.uint64(0x3D9E03F5D3), np.uint64(0x4F1BBCDCBF))


class Tokens:
    """The words of a slice without marks around them, their features' hashes by distinct word, and each one's number among these."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        self.data, self.doc, self.bounds = data, words.doc, words.bounds
        starts, ends = words.starts.copy(), words.ends.copy()
        for _ in range(16):
            cut = (ends - starts > 1) & _TAIL[data[np.maximum(ends - 1, 0)]]
            off = (ends - starts > 1) & ~cut & _HEAD[data[starts]] if len(starts) else cut
            if not (cut.any() or off.any()):
                break
            ends, starts = ends - cut, starts + off
        self.starts, self.ends = starts, ends
        n = len(starts)
        before = np.zeros(n, bool)
        if n:
            breaks = np.zeros(len(data) + 1, np.int64)
            np.cumsum(data == 10, out=breaks[1:])
            before[0] = True
            before[1:] = breaks[words.starts[1:]] > breaks[words.ends[:-1]]
        # what stands right after the word tells a pause, an end or neither
        last = np.where(ends < words.ends, data[np.minimum(ends, max(len(data) - 1, 0))], 0) if n else np.zeros(0, np.uint8)
        marks = last.astype(np.uint64) | (before.astype(np.uint64) << np.uint64(8)) | ((starts > words.starts).astype(np.uint64) << np.uint64(9))
        whole = span_hashes(data, starts, ends)
        _, at, self.which = np.unique(mix(whole ^ (marks << np.uint64(40)) ^ marks), return_index=True, return_inverse=True)
        shape = _SHAPE[data]
        edge = np.ones(len(data), bool)
        if len(data):
            edge[1:] = shape[1:] != shape[:-1]
            edge[starts] = True
        place = np.zeros(len(data) + 1, np.int64)
        np.cumsum(edge, out=place[1:])
        s, e = starts[at], ends[at]
        parts = (span_hashes(shape, s, e), span_hashes(shape[edge], place[s], place[e]), span_hashes(_LOWER[data], s, e), mix(marks[at]))
        self.features = np.stack([mix(p ^ t) for p, t in zip(parts, _TAGS, strict=True)], 1) if n else np.zeros((0, 4), np.uint64)

    def __len__(self) -> int:
        return len(self.starts)


# ---------------------------------------------------------------- the field


@dataclass(frozen=True)
class Field:
    """Weights of known features by distance and label, of a text's edges, and of label pairs; label 0 is none."""

    known: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def scores(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """Which words may be other than none, and these words' scores by label."""
        features = np.minimum(np.searchsorted(self.known, tokens.features), len(self.known) - 1) if len(self.known) else np.zeros(tokens.features.shape, np.int64)
        hit = self.known[features] == tokens.features if len(self.known) else np.zeros(features.shape, bool)
        table = self.weights[:, np.where(hit, features, len(self.known))].sum(2)  # (distances, words, labels)
        # by how much neighbours could make a label better than none
        pull = np.maximum((self.pairs - self.pairs[:, :1]).max(0), self.first - self.first[0]) + np.maximum((self.pairs - self.pairs[:1]).max(1), self.last - self.last[0])
        which, scores = [], []
        for low in range(0, len(tokens), CHUNK):
            at = np.arange(low, min(low + CHUNK, len(tokens)))
            total = table[REACH, tokens.which[at]]
            for d in range(-REACH, REACH + 1):
                if d:
                    there = np.clip(at + d, 0, len(tokens) - 1)
                    inside = (at + d == there) & (tokens.doc[there] == tokens.doc[at])
                    total = total + np.where(inside[:, None], table[REACH + d, tokens.which[there]], self.edges[REACH + d])
            open_ = (total[:, 1:] + pull[1:] >= total[:, :1] - 1e-9).any(1)
            which.append(at[open_])
            scores.append(total[open_])
        empty = np.zeros((0, self.pairs.shape[0]))
        return (np.concatenate(which), np.concatenate(scores)) if which else (np.zeros(0, np.int64), empty)

    def decode(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(word, label) of the words that are not none in the best labelling of each text."""
        at, scores = self.scores(tokens)
        if not len(at):
            return at, at
        apart = np.r_[True, (np.diff(at) > 1) | (np.diff(tokens.doc[at]) > 0)]
        begin = np.flatnonzero(apart)
        length = np.diff(np.r_[begin, len(at)])
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        opens = at[begin] == tokens.bounds[tokens.doc[at[begin]]]
        closes = at[begin + length - 1] + 1 == tokens.bounds[tokens.doc[at[begin]] + 1]
        best = scores[begin] + np.where(opens[:, None], self.first, self.pairs[0])
        back = np.zeros((len(at), self.pairs.shape[0]), np.int8)
        for t in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -t, "left"))  # runs longer than t
            step = best[:live, :, None] + self.pairs
            back[begin[:live] + t] = step.argmax(1)
            best[:live] = step.max(1) + scores[begin[:live] + t]
        label = np.zeros(len(at), np.int64)
        now = (best + np.where(closes[:, None], self.last, self.pairs[:, 0])).argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            live = int(np.searchsorted(-length, -t, "left"))
            label[begin[:live] + t] = now[:live]
            now[:live] = back[begin[:live] + t, now[:live]]
        return at[label > 0], label[label > 0]


def train(texts: list[str], labels: list[np.ndarray], kinds: int) -> Field:
    """Maximum likelihood with a ridge, by Adam steps over all texts at once; ``labels`` are by word."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    tokens = Tokens(data, offsets)
    gold, k = np.concatenate([np.zeros(0, np.int64), *labels]).astype(np.int64), kinds + 1
    # a word or shape seen once says more about its row than about its kind
    counts = np.bincount(tokens.which, minlength=len(tokens.features))
    seen, inverse = np.unique(tokens.features, return_inverse=True)
    times = np.bincount(inverse.ravel(), np.repeat(counts, tokens.features.shape[1]), len(seen))
    known = seen[times >= 3]
    found = np.searchsorted(known, tokens.features).clip(0, max(len(known) - 1, 0))
    ids = np.where(known[found] == tokens.features if len(known) else False, found, len(known))[tokens.which]
    n, reach = len(tokens), range(-REACH, REACH + 1)
    near = np.stack([np.arange(n) + d for d in reach])
    inside = (near >= 0) & (near < n)
    near = near.clip(0, max(n - 1, 0))
    inside &= tokens.doc[near] == tokens.doc
    size = len(known) + 1
    # features of (distance, word), the last number of a distance standing for a place beyond the text's edge
    slot = np.concatenate([np.where(inside[d][:, None], ids[near[d]] + d * (size + 1), d * (size + 1) + size) for d in range(len(reach))], 1)
    slot_weight = np.where(np.repeat(inside.T, ids.shape[1], 1), 1.0, 1.0 / ids.shape[1])
    count = np.diff(tokens.bounds)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    begin, length = tokens.bounds[:-1][order], count[order]
    live = [int(np.searchsorted(-length, -t, "left")) for t in range(int(length.max(initial=0)))]
    w = np.zeros(len(reach) * (size + 1) * k + k * k + 2 * k)
    cut = len(reach) * (size + 1) * k
    follow = np.flatnonzero(tokens.doc[1:] == tokens.doc[:-1])
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[follow], gold[follow + 1]), 1.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        emit, pairs, first, last = w[:cut].reshape(-1, k), w[cut : cut + k * k].reshape(k, k), w[cut + k * k : cut + k * k + k], w[cut + k * k + k :]
        score = (emit[slot] * slot_weight[:, :, None]).sum(1)
        fore, rear = np.zeros((n, k)), np.zeros((n, k))
        fore[begin] = first + score[begin]
        for t in range(1, len(live)):
            at = begin[: live[t]] + t
            fore[at] = _logsum(fore[at - 1][:, :, None] + pairs, 1) + score[at]
        rear[begin + length - 1] = last
        for t in range(len(live) - 1, 0, -1):
            at = begin[: live[t]] + t
            rear[at - 1] = _logsum(pairs + (score[at] + rear[at])[:, None, :], 2)
        whole = np.zeros(len(texts))
        whole[order] = _logsum(fore[begin + length - 1] + last, 1)
        chance = np.exp(fore + rear - whole[tokens.doc][:, None])
        two = np.exp(fore[follow][:, :, None] + pairs + (score[follow + 1] + rear[follow + 1])[:, None, :] - whole[tokens.doc[follow]][:, None, None])
        gap = chance.copy()
        gap[np.arange(n), gold] -= 1
        grad = np.zeros_like(w)
        flat = grad[:cut].reshape(-1, k)
        for j in range(k):
            flat[:, j] = np.bincount(slot.ravel(), (slot_weight * gap[:, j : j + 1]).ravel(), len(flat))
        grad[cut : cut + k * k] = (two.sum(0) - gold_pairs).ravel()
        grad[cut + k * k : cut + k * k + k] = gap[begin].sum(0)
        grad[cut + k * k + k :] = gap[begin + length - 1].sum(0)
        grad = grad / max(len(order), 1) + RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    emit = w[:cut].reshape(len(reach), size + 1, k)
    weights = emit[:, :size].copy()
    return Field(known, weights, emit[:, size].copy(), w[cut : cut + k * k].reshape(k, k), w[cut + k * k : cut + k * k + k], w[cut + k * k + k :])


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def learn(table: pd.DataFrame | DataFrame | None = None) -> Field:
    """The field of a labelled table (text, spans of (kind, start, end)); without one, of ``labelled_table()``.

    At most ``TABLE_ROWS`` rows are taken. Null texts are empty, and spans of unknown kinds are ignored; a word is
    of the kind of the span that covers its first sign. An empty table gives a field that tags nothing.
    """
    if table is None:
        table = labelled_table()
    rows = table.head(TABLE_ROWS) if isinstance(table, pd.DataFrame) else table.select("text", "spans").limit(TABLE_ROWS).toPandas()
    texts, labels = [t if isinstance(t, str) else "" for t in rows["text"]], []
    for text, spans in zip(texts, rows["spans"], strict=True):
        raw = text.encode()
        tokens = Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        own = np.zeros(len(tokens), np.int64)
        for kind, a, b in spans if spans is not None else ():
            if kind in KINDS:
                start, end = len(text[:a].encode()), len(text[:b].encode())
                own[(tokens.ends > start) & (tokens.starts < end)] = KINDS.index(kind) + 1
        labels.append(own)
    if not any(len(x) for x in labels):
        k = len(KINDS) + 1
        return Field(np.zeros(0, np.uint64), np.zeros((2 * REACH + 1, 1, k)), np.zeros((2 * REACH + 1, k)), np.zeros((k, k)) - np.arange(k).clip(0, 1), np.zeros(k), np.zeros(k))
    return train(texts, labels, len(KINDS))


# ---------------------------------------------------------------- both together


def _believed(kind: str, text: str) -> bool:
    """Whether a tagged piece of text can be of its kind at all."""
    digits = _digits(text)
    if kind == "phone":
        return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in text)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in text)
    if kind == "ip":
        return bool(_IP.fullmatch(text)) and all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in text.split("."))
    if kind == "email":
        return _SPELLED.fullmatch(text) is not None
    if kind == "address":
        return bool(digits) and any(c.isupper() for c in text) and "\n" not in text
    return _NAME.fullmatch(text) is not None and len(set(text.split())) == len(text.split())


def added_spans(tokens: Tokens, field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """The field's spans of each text that can be of their kind and touch none of the patterns' spans."""
    out: list[list[Span]] = [[] for _ in texts]
    at, label = field.decode(tokens)
    if not len(at):
        return out
    signs = np.zeros(len(tokens.data) + 1, np.int64)
    np.cumsum((tokens.data & 0xC0) != 0x80, out=signs[1:])
    first = np.cumsum([0, *(len(t) for t in texts)])
    cut = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(label) != 0) | (np.diff(tokens.doc[at]) > 0)])
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(at)], strict=True):
        doc, kind = int(tokens.doc[at[lo]]), KINDS[label[lo] - 1]
        place = [(int(signs[tokens.starts[w]] - first[doc]), int(signs[tokens.ends[w]] - first[doc])) for w in at[lo:hi]]
        text = texts[doc]
        # a run is one item, or else, as of numbers side by side, each word that is one alone
        pieces = [(place[0][0], place[-1][1])] if _believed(kind, text[place[0][0] : place[-1][1]]) else [p for p in place if _believed(kind, text[p[0] : p[1]])] if len(place) > 1 else []
        out[doc] += [(kind, a, b) for a, b in pieces if all(b <= c or a >= d for _, c, d in base[doc])]
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, base, added, spans) of every whole text: the patterns' spans, the field's, and all of them, written as ``kind:start:end``.

    Places are code points, ends exclusive; spans are in the order of ``KINDS``, then of their starts. A null
    or empty text has none. Repeated rows have a row each; a null id is kept. A long text is one chain,
    decoded whole. An empty table gives no rows, and other columns are ignored.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base_of, added_of, spans_of = [], [], []
            for _, data, offsets in slices(batch["text"]):
                texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                base = [base_spans(t) for t in texts]
                added = added_spans(Tokens(data, offsets), field, texts, base)
                base_of += map(_written, base)
                added_of += map(_written, added)
                spans_of += [_written(a + b) for a, b in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.string()) for c in (base_of, added_of, spans_of))], names=["doc_id", "base", "added", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidied(step), f"doc_id {kind}, base string, added string, spans string")

