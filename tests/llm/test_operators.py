"""Each operator on nulls, empty and long texts, ties, repeated rows, clashing columns and no rows; brute-force checks."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tideline.llm import components, graph_search, hash_ring, langid, mixing, ngram_join, packing, quality, queries, rans, toxicity, url_rules

SCHEMA = "doc_id bigint, text string, lang string, source string, size bigint, copies bigint, kept boolean, row string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def word_list(seed, n):
    rng = np.random.default_rng(seed)
    return [WORDS[i] + str(j) for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 50, n))]


@pytest.fixture(scope="module")
def docs(spark):
    base = word_list(0, 200)
    near = base[:190] + ["other"] * 3 + base[193:]
    rows = [(i, " ".join(word_list(i, 60 + i)), "en", "a" if i % 3 else "b") for i in range(1, 30)]
    rows += [(100, " ".join(base), "en", "a"), (101, " ".join(base), None, None), (102, " ".join(near), "en", "a"), (103, " ".join(base).upper(), "en", "a")]
    rows += [(200, None, None, None), (201, "", "en", ""), (202, " \n\t ", "en", "a"), (203, "word", "en", "a"), (204, "word", "en", "a"), (None, "one two three four five six", "en", "a")]
    rows += [(205, "é ü ☃ <|endoftext|> x  y\r\nz", "fr", "b"), (206, " ".join(word_list(9, 30000)), "en", "b"), (203, "word", "en", "a")]
    return spark.createDataFrame([(*r, 1, 2, None, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def test_join_equals_brute_force(docs, none):
    got = {(r.doc_id): (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    texts = [(r.doc_id, shingles(r.text)) for r in docs.where("doc_id is not null").collect()]
    root = {d: d for d, _ in texts}
    for _ in texts:
        for a, x in texts:
            for b, y in texts:
                if x and y and 100 * len(x & y) >= 75 * len(x | y):
                    root[a] = root[b] = min(root[a], root[b])
    for d, s in texts:
        assert got[d] == (len(s), root[d])
    assert got[None][1] is None
    assert ngram_join.ngram_components(none).count() == 0
    kept = ngram_join.near_duplicates_removed(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (101, 102, 103, 204)").count() == 0


@pytest.mark.parametrize("rows", [1000, 2])
def test_components_with_hubs(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "HUB_ROWS", rows)
    edges = [(0, i) for i in range(1, 12)] + [(40, i) for i in range(30, 40)] + [(50, 51), (51, 52), (52, 53), (60, 60), (9, 12), (12, 9), (12, 13)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(14)}, **{i: 30 for i in range(30, 41)}, **{i: 50 for i in range(50, 54)}, 60: 60}
    left = spark.createDataFrame([(i % 3, i) for i in range(20)], "a bigint, b bigint")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (5, "z")], "a bigint, t string")
    want = sorted((i % 3, i, "xy"[i % 3]) for i in range(20) if i % 3 < 2)
    assert sorted((r.a, r.b, r.t) for r in components.hub_join(left, right, "a", "b", 20).collect()) == want


def test_of_rows_with_one_id_the_same_stays(spark):
    rows = [(1, f"text {i} of one and the same id") for i in range(6)] + [(2, None), (3, "")]
    kept = [sorted(map(str, ngram_join.near_duplicates_removed(spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)).collect())) for some in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_quality(docs, none):
    rows = {r.doc_id: r for r in quality.quality_metrics(docs).collect()}
    assert rows[200].n_words == 0 and rows[200].base_failed and not rows[200].kept
    assert rows[206].n_words == 30000 and rows[100].kept
    kept = quality.quality_filter(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if r.kept}
    assert quality.quality_metrics(none).count() == quality.quality_filter(none).count() == 0


def test_order_never_changes_the_verdict(docs):
    rules = (*quality.BASE_RULES, *quality.METHOD_RULES)
    one = sorted(str(r.doc_id) for r in quality.quality_filter(docs, rules=rules).collect())
    assert one == sorted(str(r.doc_id) for r in quality.quality_filter(docs, rules=rules[::-1]).collect())


def test_shards(docs, none):
    rows = hash_ring.assign_shards(docs, 4, cell_rows=5).collect()
    assert len(rows) == docs.count()
    counts = np.bincount([r.shard for r in rows], minlength=4)
    assert counts.max() - counts.min() <= 1
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert hash_ring.assign_shards(none, 4).count() == 0


def test_language(docs, none):
    filters = langid.learn_filters(docs)
    rows = {r.doc_id: r for r in langid.identify(docs, filters).collect()}
    assert rows[200].lang_pred == rows[201].lang_pred == "und" and rows[100].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(none, langid.learn_filters(none)).count() == 0


def test_mix(docs, none):
    rows = mixing.copies(docs, block=8).collect()
    assert len(rows) == docs.count()
    per = {}
    for r in rows:
        assert 0 <= r.copies <= 2
        per.setdefault(r.source, [0, r.target, 0])
        per[r.source][0] += r.size * r.copies
        per[r.source][2] = max(per[r.source][2], r.size)
    for taken, target, most in per.values():
        assert abs(taken - target) <= most
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, mixing.copies(docs, block=8).collect()))
    out = mixing.mixed(docs, block=8)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.copies(none).count() == 0


def test_targets_stop_and_share_the_excess(spark):
    rng = np.random.default_rng(5)
    for n in (1, 7, 40):
        sizes = {None if i == 3 else f"s{i:02}": int(v) for i, v in enumerate(rng.integers(0, 3000, n) ** 2)}
        df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, size bigint, rows bigint").repartition(3)
        names = sorted(k for k in sizes if k is not None) + [None] * (None in sizes)
        weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(names)}
        left, goal, want = set(names), 1.5 * sum(sizes.values()), {}
        while left:
            share = sum(weight[k] for k in left)
            over = {k for k in left if 2 * sizes[k] <= goal * weight[k] / share}
            if not over:
                want |= {k: goal * weight[k] / share for k in left}
                break
            want |= {k: 2 * sizes[k] for k in over}
            goal -= sum(2 * sizes[k] for k in over)
            left -= over
        got = {r.source: (r.target, r.sid) for r in mixing.source_targets(df).collect()}
        assert [got[k][1] for k in names] == list(range(1, n + 1))
        assert all(got[k][0] == pytest.approx(want[k], rel=1e-12) for k in names)


def test_toxicity(spark, docs, none):
    bad = [(1000 + i, " ".join(word_list(i, 30) + ["vileword", "vilething"] * 2), "en", "a", 1, 2, None, "x") for i in range(40)]
    every = docs.union(spark.createDataFrame(bad, SCHEMA))
    labels = spark.createDataFrame([(1000 + i, 1) for i in range(40)] + [(i, 0) for i in range(1, 30)] + [(None, 1), (100, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(every, labels)
    rows = {r.doc_id: r.score for r in toxicity.toxicity_scores(every, model).collect()}
    assert min(rows[1000 + i] for i in range(40)) >= 0.3 > max(rows[i] for i in range(1, 30))
    assert rows[200] < 0.3 and rows[201] < 0.3
    kept = toxicity.toxic_removed(every, model)
    assert kept.columns == every.columns and kept.where("doc_id >= 1000").count() == 0
    assert toxicity.toxicity_scores(none, toxicity.learn(none, labels.limit(0))).count() == 0


def test_toxicity_without_words_or_classes(spark, docs):
    labels = spark.createDataFrame([(200, 1), (201, 0), (202, 1), (None, 0)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.toxicity_scores(docs, toxicity.learn(docs, some)).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_conflicting_labels_and_repeated_ids_give_one_model(spark):
    rows = [(i % 50, " ".join(word_list(i, 20) + ["vile"] * (i % 50 < 10))) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(50)] + [(i, 0) for i in range(5)], "doc_id bigint, toxic int")
    scores = []
    for k in (1, 7):
        every = spark.createDataFrame(rows[::k] + [r for i, r in enumerate(rows) if i % k], "doc_id bigint, text string").repartition(k)
        scores.append(sorted((r.doc_id, r.score) for r in toxicity.toxicity_scores(every, toxicity.learn(every, labels)).collect()))
    assert scores[0] == scores[1]


def test_toxic_scores_equal_a_plain_loop():
    rng = np.random.default_rng(4)
    model = toxicity.ToxicityModel(rng.normal(size=toxicity.BUCKETS).astype(np.float32), 0.3, (1.5, 0.25), -0.7)
    texts = [" ".join(word_list(i, 5 + 40 * i)) for i in range(6)] + ["Päth3tic, x", ""]

    def logit(word):
        words = toxicity.Words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word.encode())]), lower=True)
        raw, grams = b"<" + word.lower().encode() + b">", []
        for size in toxicity.SIZES:
            for k in range(len(raw) - size + 1):
                h = 0
                for byte in raw[k : k + size]:
                    h = (h * 0x100000001B3 + byte + 1) % 2**64
                grams.append(int(toxicity.mix(np.array([(h + ((size) << 56)) % 2**64], np.uint64))[0]) % toxicity.BUCKETS)
        grams.append(int(toxicity.mix(words.hashes() ^ np.uint64(0x5851F42D4C957F2D))[0]) % toxicity.BUCKETS)
        return np.mean([float(model.logit[g]) for g in grams])

    data = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    got = model.score(np.frombuffer(data, np.uint8), offsets)
    for text, score in zip(texts, got, strict=True):
        each = [logit(w) for w in text.split()]
        want = 1 / (1 + np.exp(-(1.5 * (np.mean(each) + 0.3) + 0.25 * (max(each) + 0.3) - 0.7))) if each else 0
        assert abs(score - want) < 1e-6


def test_bags_are_the_texts_means():
    texts = [" ".join(word_list(i, 30 + i)) for i in range(4)] + [""]
    logit = np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32)
    model = toxicity.ToxicityModel(logit, 0.0, (1.0, 0.0), 0.0)
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum(list(map(len, texts)))])
    want = model.inputs(data, offsets)[0][:, 0]
    got = [float(weight @ logit[bucket]) for bucket, weight in toxicity.bags(toxicity.pa.array(texts))]
    assert np.allclose(got, want, atol=1e-4)


def test_pieces_give_the_texts_back(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.pack(docs, path).collect()
    library = rans.encoder(path).library
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for d, ps in by_doc.items():
        if d == 203:
            assert len(ps) == 2
            ps = ps[:1]
        ids = b"".join(p.ids for p in sorted(ps, key=lambda p: p.start))
        assert np.frombuffer(ids, "<u4").tolist() == want[d]
    assert set(by_doc) == set(want)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at <= 1024
    assert packing.pack(none, path).count() == 0


def test_ids_come_back_from_the_files(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = sorted(rans.round_trip(docs, path).collect(), key=lambda r: r.start)
    library, start = rans.encoder(path).library, 0
    want = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    for r in rows:
        assert r.start == start and np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id]
        start += r.n_tokens
    assert len(rows) == docs.count() and [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert rans.round_trip(none, path).count() == 0


def test_files_are_read_from_their_path_alone(docs, spark, tmp_path):
    rans.write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/ids")
    other = spark.newSession()
    rows = rans.read_ids(other, f"{tmp_path}/ids").collect()
    assert len(rows) == docs.count() and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    table = rans.read_table(other, f"{tmp_path}/ids")
    assert int(table.freq.sum()) == 1 << rans.SCALE
    with pytest.raises(ValueError):
        other.createDataFrame([], rans._FORMAT).write.mode("overwrite").parquet(f"{tmp_path}/ids/table")
        rans.read_table(other, f"{tmp_path}/ids")


def test_damage_is_found():
    ids = np.random.default_rng(0).integers(0, 300, 5000).astype(np.uint32)
    table = rans.Table.of(np.bincount(ids))
    slots = np.repeat(np.arange(len(table.freq), dtype=np.uint32), table.freq.astype(np.int64))
    row = rans.write_frame(0, 0, 0, [(1, ids)], table)
    assert (rans.read_frame(row, table, slots) == ids).all()
    spoiled = bytearray(row["words"])
    spoiled[len(spoiled) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.read_frame(row | {"words": bytes(spoiled)}, table, slots)


def test_graph_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 12)).round(3)
    x[300:900] = x[299]
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)] + [(5000, None, "x"), (5100, [0.0] * 12, "x"), (5200, [float("nan")] + [1.0] * 11, "x"), (5300, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    found = graph_search.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=300).collect()
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(abs(d[r.vec_id] - r.score) < 1e-12 for r in mine)
        hits, total = hits + len(set(want) & {r.vec_id for r in mine}), total + 10
    assert hits / total >= 0.9
    assert not {r.query_id for r in found} & {5000, 5100, 5200}
    assert graph_search.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("offset, scale", [(1e4, 1.0), (1e8, 1.0), (0.0, 1e20), (0.0, 1e-25), (0.0, 1e180), (-3e5, 1e3)])
def test_graph_recall_whatever_the_place_and_unit(spark, offset, scale):
    x = np.random.default_rng(2).normal(size=(600, 8)) * scale + offset
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found = graph_search.nearest(df, F.col("vec_id") % 100 == 0, shard_rows=250).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = graph_search.distances(x - x[q])
        want = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        mine = [r for r in found if r.query_id == q]
        assert len(mine) == 10 and all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in mine)
        hits += len(set(want) & {r.vec_id for r in mine})
    assert hits / 60 >= 0.9


def test_graph_search_of_repeated_ids(spark):
    x = np.random.default_rng(3).normal(size=(40, 4))
    rows = [(i % 20, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 30 + [(7, x[7].tolist())] * 30
    found = graph_search.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).collect()
    gaps = {i: min(np.linalg.norm(x[a] - x[b]) for a in (0, 20) for b in (i, i + 20)) for i in range(1, 20)}
    want = sorted(gaps, key=lambda i: (gaps[i], i))[:10]
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == want
    assert all(r.score == pytest.approx(gaps[r.vec_id]) for r in found)


def brute_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.org/es/1", "http://b.org", "x", None, "", "https://c.com/de/?q=1", "https://c.com/fr/#x", "https://example.org/en/12", "ftp://fakeexample.org/es/", "http://c.com/de"] * 3
    urls += [f"http://spam{i % 4}.example.com/de/{i}" for i in range(60)] + [f"http://ok{i % 4}.example.com/fr/{i}" for i in range(60)] + ["http://spam1.example.com/x", "http://ok1.example.com/x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    rows = {r.page_id: r for r in url_rules.filter_urls(df).collect()}
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict if verdict else rows[i].verdict in ("allow", "block")
    assert rows[len(urls) - 2].verdict == "block" and rows[len(urls) - 1].verdict == "allow"
    assert url_rules.filter_urls(df.limit(0)).count() == 0


def brute_verdicts(spark, urls, support, confidence, lift):
    """Verdicts of open urls by trying every combination of frequent tokens."""
    tokens = {r.url: set(r.t) for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    labelled = [(tokens[u], brute_rule(u)[3]) for u in urls if brute_rule(u)[3]]
    n, by_token = len(labelled), {}
    for i, (t, _) in enumerate(labelled):
        for token in t:
            by_token.setdefault(token, set()).add(i)
    frequent = [t for t, rows in by_token.items() if len(rows) >= support * n]
    stands = {}
    for t in sorted(frequent, key=lambda t: (len(t), t)):
        stands.setdefault(frozenset(by_token[t]), t)
    frequent, verdicts = sorted(stands.values()), {v for _, v in labelled}
    assert len(frequent) <= url_rules.TOKENS
    rules = []
    for size in range(1, len(frequent) + 1):
        for some in itertools.combinations(frequent, size):
            rows = set.intersection(*(by_token[t] for t in some))
            for v in verdicts:
                both, share = sum(labelled[i][1] == v for i in rows), sum(w == v for _, w in labelled) / n
                if rows and both >= support * n and both / len(rows) >= confidence and both / len(rows) / share >= lift:
                    rules.append((both / len(rows), both / n, -size, v == "block", list(some), v))
    return {u: max((r for r in rules if set(r[4]) <= tokens[u]), default=[None, None, None, None, None, "allow"])[5] for u in urls if not brute_rule(u)[3]}


def test_mined_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    hosts, deep = ["a.example.com", "b.example.com", "example.org"], ["x", "shop", "news"]
    urls = [f"http://{hosts[rng.integers(3)]}/{('de', 'fr', 'es')[rng.integers(3)]}/p/q/{deep[rng.integers(3)]}" for _ in range(80)]
    urls += [f"http://{h}.net/{k}/p/q/{d}?tag=1" for h in ("a.example", "zz") for k in ("de", "fr") for d in deep] + ["http://" + "a." * 40 + "net/" + "p/" * 60]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.url: r.verdict for r in url_rules.filter_urls(df, support=0.05, confidence=0.7, lift=1.05).collect()}
    want = brute_verdicts(spark, urls, 0.05, 0.7, 1.05)
    assert {u: got[u] for u in want} == want and len(set(want.values())) == 2


def test_a_deep_path_part_is_mined(spark):
    kinds = ["misc" if i % 8 < 2 else "bad" if i % 2 else "good" for i in range(80)]
    urls = [f"http://x{i}.com/{'de' if i % 2 else 'fr'}/one/two/three/{kind}/z" for i, kind in enumerate(kinds)]
    urls += ["http://y.net/a/one/two/three/bad/z", "http://y.net/a/one/two/three/good/z"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.url: r.verdict for r in url_rules.filter_urls(df).collect()}
    assert got[urls[80]] == "block" and got[urls[81]] == "allow"


def test_queries_carry_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op10_token_ids(spark, sf).collect()
    assert {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(rows[0].asDict())
    text = spark.read.parquet(f"{sf}/documents.parquet").where(f"doc_id = {rows[0].doc_id}").first().text
    ids = rans.encoder(public_tokenizers.path("word_bpe_49k.json")).library.encode(text or "", add_special_tokens=False).ids + [1]
    assert rows[0].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
