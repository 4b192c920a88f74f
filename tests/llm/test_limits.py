"""Operators past the sizes at which they change their way: hot keys, many blocks, texts beyond a shard, ids beyond a broadcast."""

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

from tideline.llm import graph_search, mixing, ngram_join, packing, rans
from tideline.llm.storage import materialise


def test_many_rows_of_one_null_id_are_mixed_alike(spark):
    # 3,000 rows with no id and one source and size, beside a small source
    hot = spark.range(3000).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id")).alias("text"), F.lit("a").alias("source"), F.col("id").alias("extra"))
    rest = spark.range(50).select("id", F.lit("four five six seven").alias("text"), F.lit("b").alias("source"), F.col("id").alias("extra"))
    docs = hot.union(rest)
    decided = mixing.copies(docs, block=16).toPandas()
    assert len(decided) == 3050 and decided.copies.between(0, 2).all()
    for _, g in decided.groupby("source"):
        assert abs((g["size"] * g.copies).sum() - g.target.iloc[0]) <= g["size"].max()
    out = mixing.mixed(docs, block=16).toPandas()
    assert len(out) == decided.copies.sum()
    times = out[out.source == "a"].groupby("extra").size()
    assert times.max() - times.min() <= 1 or len(times) < 3000
    again = mixing.mixed(docs.repartition(7), block=16).toPandas()
    assert sorted(map(tuple, out.astype(str).to_numpy())) == sorted(map(tuple, again.astype(str).to_numpy()))


def test_query_blocks_and_shards_change_no_recall(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(900), "vec": x.astype(float).tolist()}))
    index = graph_search.build_index(rows, shard_rows=150)
    got = graph_search.search_index(index, rows.where("vec_id % 10 = 0"), block=7).toPandas()
    gap = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    np.fill_diagonal(gap, np.inf)
    hits = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(g.score, gap[q, g.vec_id])
        hits += (g.score.to_numpy() <= np.sort(gap[q])[9] + 1e-12).sum()
    assert got.query_id.nunique() == 90 and hits >= 0.9 * 900


def test_a_text_beyond_a_shard_is_packed_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {i: " ".join(f"word{(i * j) % 97}" for j in range(1, 40)) for i in range(1, 30)} | {99: " ".join(f"long{j % 501}" for j in range(6000))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    pieces = packing.pack(docs, path, shard_bytes=4096).toPandas()
    library = rans.encoder(path).library
    for d, g in pieces.groupby("doc_id"):
        ids = np.concatenate([np.frombuffer(v, "<u4") for v in g.sort_values("start").ids])
        assert ids.tolist() == [*library.encode(texts[d], add_special_tokens=False).ids, 0]
    assert set(pieces.doc_id) == set(texts) and (pieces.groupby("sequence_id").length.sum() <= 1024).all()


def test_components_without_broadcasts(spark, monkeypatch):
    # stars around one text: its id is an end of every link
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[:i] + [f"x{i}"] + words[i + 1 :])) for i in range(60)] + [(900, " ".join(words)), (901, " ".join(words)), (902, None), (903, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = {tuple(r) for r in ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()}
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    got = {tuple(r) for r in ngram_join.ngram_components(docs).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == want and {c for d, _, c in got if d <= 901} == {0} and (902, 0, 902) in got


def test_copies_in_many_tasks_are_posted_once(spark, monkeypatch):
    # 4 texts that share shingles and do not link, and one that links with the first; each 12 times over 12 tasks
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words[:60] + [f"x{k}y{i}" for i in range(40)]) for k in range(4)]
    texts.append(texts[0].replace("x0y39", "other"))
    rows = [(100 * k + i, t) for i, t in enumerate(texts) for k in range(12)]
    # one id with a copy and with a text that only links to another, and a copy of that text
    lone = " ".join(f"z{i}" for i in range(80))
    rows += [(5000, texts[1]), (5000, lone), (5001, lone.replace("z79", "end")), (5002, lone), (None, lone)]
    sizes = {}

    def counted(df, name="step"):
        out = materialise(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(12, "doc_id")
    want = {(i + 100 * k): 0 if i in (0, 4) else i for i in range(5) for k in range(12)} | {5000: 1, 5001: 1, 5002: 1}
    for broadcast in (ngram_join.BROADCAST_IDS, 0):
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", broadcast)
        sizes.clear()
        got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(docs).where("doc_id is not null").collect()}
        assert got == want
        # of each of the 7 sets one document, but two where an id holds several texts
        prefix = max(ngram_join.prefix_length(len(t.split()) - 4) for t in texts)
        assert sizes["lists"][0] <= 9 * prefix and max(sizes["stars"] + sizes["pairs"]) <= 36
