"""Personal data: patterns against the plain ones, the field on labelled texts that it has not seen, and odd rows."""

import itertools
import re

import numpy as np
import pandas as pd
import pytest

from tideline.llm import pii, queries
from tideline.llm.pii_table import labelled_table


@pytest.fixture(scope="module")
def field():
    return pii.learn()


def plain_spans(text):
    """The patterns as they are stated."""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * v, 10)) for v in d[-2::-2])) % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_patterns_equal_the_plain_ones():
    rng = np.random.default_rng(0)
    for alphabet in ("a@.-", "0123.", "01 -", "+0123456789 ().-", "a1@+. -é\n0", "0123456789 -"):
        for length in (3, 8, 20, 60, 200):
            for _ in range(150):
                text = "".join(alphabet[i] for i in rng.integers(0, len(alphabet), length))
                assert sorted(pii.base_spans(text)) == sorted(plain_spans(text)), text
    known = "a.b+c@x-y.org, 10.0.0.256 10.0.0.25, 4111 1111 1111 1111, +1 (487) 555-7209."
    assert sorted(pii.base_spans(known)) == sorted(plain_spans(known)) and len(pii.base_spans(known)) == 4


@pytest.mark.parametrize("piece", ["1", "a", "1.", "+1 ", "a@", "@a", "1-", ".", "a.a@"])
def test_patterns_on_long_texts(piece):
    pii.base_spans(piece * (1_000_000 // len(piece)))


def decoded(field, texts):
    raw = [t.encode() for t in texts]
    tokens = pii.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    base = [pii.base_spans(t) for t in texts]
    return base, pii.added_spans(tokens, field, texts, base)


def test_spans_of_unseen_rows(field):
    rows = labelled_table(600, seed=99)
    base, added = decoded(field, rows.text.to_list())
    right = found = wanted = 0
    for text, spans, b, a in zip(rows.text, rows.spans, base, added, strict=True):
        want = {s for s in spans if s[0] != "card" or pii.luhn("".join(c for c in text[s[1] : s[2]] if c.isdigit()))}
        right, found, wanted = right + len(want & {*a, *b}), found + len({*a, *b}), wanted + len(want)
    assert right >= 0.88 * found and right >= 0.88 * wanted


def test_numbers_side_by_side_are_found(field):
    text = "Hean. Esanwh +1 (826) 555-4081 190.137.223.204 thheed 2353820953013749 4550997810720808 hand"
    base, added = decoded(field, [text])
    assert base[0] == [] or all(s[0] != "phone" for s in base[0])
    assert {("phone", "+1 (826) 555-4081"), ("card", "4550997810720808")} <= {(k, text[a:b]) for k, a, b in added[0]}


def brute(field, tokens, doc):
    """The best labelling of one text by trying all."""
    at = range(tokens.bounds[doc], tokens.bounds[doc + 1])
    hit = np.searchsorted(field.known, tokens.features).clip(0, len(field.known) - 1)
    hit = np.where(field.known[hit] == tokens.features, hit, len(field.known))
    score = {}
    for w in at:
        score[w] = sum(field.weights[d + pii.REACH, hit[tokens.which[w + d]]].sum(0) if w + d in at else field.edges[d + pii.REACH] for d in range(-pii.REACH, pii.REACH + 1))
    best = max(itertools.product(range(field.pairs.shape[0]), repeat=len(at)), key=lambda y: field.first[y[0]] + field.last[y[-1]] + sum(score[w][k] for w, k in zip(at, y, strict=True)) + sum(field.pairs[a, b] for a, b in itertools.pairwise(y)))
    return {w: k for w, k in zip(at, best, strict=True) if k}


def test_viterbi_is_exact():
    rng = np.random.default_rng(5)
    texts = ["call me 555", "at 1 dot b", "x", "My name is Bo"]
    raw = [t.encode() for t in texts]
    tokens = pii.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    known = np.unique(tokens.features)
    for _ in range(20):
        k = 4
        field = pii.Field(known, np.concatenate([rng.normal(0, 0.6, (5, len(known), k)), np.zeros((5, 1, k))], 1), rng.normal(0, 1, (5, k)), rng.normal(0, 2, (k, k)), rng.normal(0, 1, k), rng.normal(0, 1, k))
        got = dict(zip(*(a.tolist() for a in field.decode(tokens)), strict=True))
        assert got == {w: y for d in range(len(texts)) for w, y in brute(field, tokens, d).items()}


def test_gradient_is_that_of_the_likelihood(monkeypatch):
    """More steps make the marked words likelier, on the rows themselves."""
    rows = labelled_table(60, seed=3)
    monkeypatch.setattr(pii, "STEPS", 60)
    field = pii.learn(rows)
    _, added = decoded(field, ["my number is (487) 555-7209."])
    assert added[0] == [("phone", 13, 27)]


def test_odd_rows(spark, field):
    long = ("word " * 40_000) + "call me at (487) 555-7209 now " + "x" * 100_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "é☃ a@b.org"), (4, "é☃ a@b.org"), (None, "10.1.2.3"), (5, long)]
    docs = spark.createDataFrame([(*r, "b", "s", 1) for r in rows], "doc_id bigint, text string, base string, spans string, added int")
    got = sorted(((r.doc_id, r.base, r.added, r.spans) for r in pii.find(docs, field).collect()), key=str)
    assert (1, "", "", "") in got and (2, "", "", "") in got and (3, "", "", "") in got
    assert got.count((4, "email:3:10", "", "email:3:10")) == 2 and (None, "ip:0:8", "", "ip:0:8") in got
    assert (5, "", "phone:200011:200025", "phone:200011:200025") in got and len(got) == len(rows)
    assert pii.find(docs.limit(0), field).count() == 0


def test_an_empty_table_tags_nothing():
    field = pii.learn(pd.DataFrame({"text": [None, ""], "spans": [None, []]}))
    assert decoded(field, ["my number is (487) 555-7209", ""])[1] == [[], []]


def test_query_keeps_base_spans(spark):
    rows = queries.op11_pii(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        want = plain_spans(docs[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r.spans.split(","))
