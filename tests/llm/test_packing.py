"""Packing: related documents meet whatever the number of shards, by counts over all documents."""

import numpy as np
import public_tokenizers
import pytest

from tideline.llm import cells, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def topics(spark):
    """40 topics of 12 texts, dealt over ids: 20 words of the topic and 20 of all texts each."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join([f"topic{i % 40}x{k}" for k in rng.integers(0, 25, 20)] + [f"common{k}" for k in rng.integers(0, 200, 20)])) for i in range(480)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_related_texts_meet_in_small_windows(topics):
    pieces = packing.pack(topics, PATH, window=2048).collect()
    windows = {}
    for p in pieces:
        windows.setdefault(p.sequence_id, set()).add(p.doc_id)
    met = {}
    for docs in windows.values():
        for d in docs:
            met.setdefault(d, set()).update(docs)
    near = [sum(j in met[i] for j in range(i % 40, 480, 40)) - 1 for i in range(480)]
    assert np.mean(near) / np.mean([len(m) - 1 for m in met.values()]) > 0.15  # by chance 0.02


def test_shards_hold_bytes_and_order():
    sizes = np.random.default_rng(1).integers(1, 900, 500)
    sizes[100] = 5000
    rows = packing.pa.RecordBatch.from_arrays([packing.pa.array(range(500)), packing.pa.array(["x"] * 500), packing.pa.array(sizes)], names=["doc_id", "text", "size"])
    found = list(packing.shards(iter([rows.slice(0, 7), rows.slice(7, 300), rows.slice(307)]), 3000))
    assert [i for t in found for i in t["doc_id"].to_pylist()] == list(range(500))
    assert all(sum(t["size"].to_pylist()) <= 3000 or t.num_rows == 1 for t in found)
    assert len(found) <= 2 + 1.3 * sizes.sum() / 3000


def test_related_texts_share_codes(topics):
    rows = topics.collect()
    column = packing.pa.array([r.text for r in rows])
    corpus = packing.Corpus.count(topics)
    x = np.concatenate([x for _, x, _ in packing.vectors(column, corpus)])
    order = np.argsort(packing.codes(column, corpus, packing.Centres.grow(x, 16)), kind="stable")
    shard = np.empty(480, int)
    shard[order] = np.arange(480) // 30
    met = [sum(shard[j] == shard[i] for j in range(i % 40, 480, 40)) - 1 for i in range(480)]
    assert np.mean(met) / 11 > 0.6


def test_copies_beyond_a_shard_are_split(spark):
    docs = spark.createDataFrame([(None if i % 2 else i, "the same words in every text of this group") for i in range(300)], "doc_id bigint, text string")
    pieces = packing.pack(docs, PATH, shard_bytes=2000, part_bytes=8000).collect()
    assert sorted(p.doc_id or 0 for p in pieces if p.start == 0) == sorted(0 if i % 2 else i for i in range(300))
    assert len({p.sequence_id >> 32 for p in pieces}) > 1


def test_counts_are_of_all_documents(topics):
    corpus = packing.Corpus.count(topics)
    words = [r.text.split() for r in topics.collect()]
    df = {}
    for w in words:
        for term in set(w):
            df[term] = df.get(term, 0) + 1
    assert (corpus.n, corpus.words) == (480, sum(map(len, words)))
    names = sorted(df)
    terms = np.concatenate([next(packing.postings(packing.pa.array([w])))[2] for w in names])
    want = np.array([df[w] for w in names])
    assert np.all(np.abs(corpus.frequency(terms) / want - 1) < 0.03)  # up to the scale's steps


def _index(texts):
    words = [t.split() for t in texts]
    distinct = sorted({w for ws in words for w in ws})
    term = {w: next(packing.postings(packing.pa.array([w])))[2][0] for w in distinct}
    df = {w: sum(w in ws for ws in words) for w in distinct}
    counts = np.zeros(cells.CELLS, np.int64)
    for w in distinct:
        counts[int(term[w]) % cells.CELLS] += df[w]
    corpus = packing.Corpus(len(texts), sum(map(len, words)), 0, (np.log2(counts + 1) * cells.STEPS).astype(np.uint16))
    scores = np.zeros((len(texts), len(texts)))
    for i, seed in enumerate(words):
        for j, doc in enumerate(words):
            for w in set(seed) & set(doc):
                scores[i, j] += corpus.weigh(corpus.frequency(np.array([term[w]]))[0], np.array(doc.count(w)), np.array(len(doc)))
    return packing.BM25(packing.pa.array(texts), corpus), scores


def test_neighbours_are_ranked_by_all_terms_of_the_seed():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{k}" for k in (rng.random(30) ** 2 * 120).astype(int)) for _ in range(150)]
    index, scores = _index(texts)
    used = np.zeros(150, bool)
    used[::7] = True
    for forget in (False, True):
        if forget:
            index.forget(used)
        for seed in (0, 35, 149):
            got = list(index.neighbours([3, seed], used | (np.arange(150) == seed))[1])
            want = [j for j in range(150) if scores[seed, j] > 0 and not used[j] and j != seed]
            assert sorted(got) == want
            assert np.all(np.diff(scores[seed, got]) <= 1e-4)


def test_common_terms_find_company_when_rare_ones_are_used_up():
    # 20 terms of the seed occur in one other text each; "shared" is in half of all texts
    texts = ["shared " + " ".join(f"rare{k}" for k in range(20))]
    texts += [f"other{k} only{k}" for k in range(30)] + [f"rare{k} x{k}" for k in range(20)] + [f"shared y{k}" for k in range(30)]
    index, _ = _index(texts)
    order = packing.layout(index, np.full(len(texts), 10), window=600, abreast=1)[0]
    assert set(order[:51]) == {0, *range(31, 81)}
