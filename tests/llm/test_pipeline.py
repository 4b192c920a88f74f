"""The corpus pipeline, stage by stage, on documents with nulls, copies, repeated rows and clashing columns."""

import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import langid, mixing, rans, toxicity
from tideline.llm.storage import materialise

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, row string, kept boolean"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def passes(text):
    w = words_of(text)
    if len(w) < 50:
        return False
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    chars, lines = sum(map(len, w)), [x for x in text.split("\n") if words_of(x)]
    upper, alpha = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    bad = 100 * len(often) > 50 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", text)) > 7 * chars or 2 * upper > alpha > 0
    return not (bad or 2 * text.count("!") > len(w) or not 2 * len(w) <= chars <= 20 * len(w) or 2 * (len(lines) - len(set(lines))) > len(lines))


def shingles(text):
    w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(400)]
    texts = {i: " ".join(rng.choice(vocabulary, rng.integers(60, 160))) for i in range(1, 120)}
    for i in range(100, 120):
        texts[i] += " vileword nasty vileword"
    texts[10] = texts[11] = texts[5]
    texts[12] = texts[6] + " and more"
    texts |= {200: None, 201: "", 202: "short text", 203: "same words again " * 40, 204: "LOUD " * 80, 205: " ".join(rng.choice(vocabulary, 20000))}
    rows = [(i, t, "en", "a" if i % 3 else None, len(t or ""), 1, "r", True) for i, t in texts.items()]
    rows += [rows[20], (None, texts[30] + " but without an id", "en", "b", 1, 1, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 120)) for i in range(1, 120)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]
    key = lambda r: (str(r.doc_id), str(r.text))

    def step(name, docs):
        out = materialise(stages[name](spark, docs, folder), "test")
        assert name == "packing" or out.columns == docs.columns
        return out, out.collect()

    every = docs.collect()
    docs, rows = step("quality rules", docs)
    assert sorted(map(key, rows)) == sorted(key(r) for r in every if passes(r.text))
    model = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {key(r): r.score for r in toxicity.toxicity_scores(docs.select("doc_id", "text"), model).join(docs.select("doc_id", "text"), "doc_id", "left").collect()}
    before = rows
    docs, rows = step("toxicity", docs)
    kept = {key(r) for r in rows}
    assert all((key(r) in kept) == (scores[key(r)] < toxicity.THRESHOLD) for r in before if r.doc_id is not None)
    assert not any(100 <= (r.doc_id or 0) < 120 for r in rows) and {r.doc_id for r in before if (r.doc_id or 0) < 100} <= {r.doc_id for r in rows}

    root = {r.doc_id: r.doc_id for r in rows if r.doc_id is not None}
    sets = [(r.doc_id, shingles(r.text)) for r in rows if r.doc_id is not None]
    for _ in range(3):
        for i, x in sets:
            for j, y in sets:
                if 100 * len(x & y) >= 75 * len(x | y):
                    root[i] = root[j] = min(root[i], root[j])
    docs, rows = step("near duplicates", docs)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(i for i, low in root.items() if i == low)
    assert {10, 11, 12}.isdisjoint(root.keys() & {r.doc_id for r in rows})

    decided = {(r.doc_id, r.source): r.copies for r in mixing.copies(docs).collect()}
    docs, rows = step("mixing", docs)
    taken = {}
    for r in rows:
        taken[(r.doc_id, r.source)] = taken.get((r.doc_id, r.source), 0) + 1
    assert taken == {k: n for k, n in decided.items() if n}

    _, pieces = step("packing", docs)
    library = rans.encoder(public_tokenizers.path("byte_bpe_50k.json")).library
    assert sum(p.length for p in pieces) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in rows)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in rows}


def test_whole_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_held_out_labels_are_not_learned(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(langid.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert (one.logit == two.logit).all() and one.slopes == two.slopes
