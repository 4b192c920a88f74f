"""Language identification with more languages than a word of the mask has bits."""

import numpy as np

from tideline.llm import langid


def test_more_than_64_languages(spark):
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, 7)) for _ in range(150 * 12)]
    rows = [(1000 * i + k, " ".join(rng.choice(words[12 * i : 12 * i + 12], 30)), f"l{i:03}") for i in range(150) for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    filters = langid.learn_filters(docs)
    assert len(filters.languages) == 150 and filters.slots.shape == (3, langid.SLOTS)
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs, filters).collect()}
    assert np.mean([found[d] == lang for d, _, lang in rows]) > 0.99


def made_up(spark, n=400):
    """Texts of four made-up languages with shared letters, of which the ids decide who is held out."""
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnop"))
    chance = [rng.dirichlet(np.full(16, 0.6), 17) for _ in range(4)]
    rows = []
    for i in range(n):
        out, at = [], 16
        for _ in range(rng.integers(80, 200)):
            at = rng.choice(16, p=chance[i % 4][at])
            out.append(letters[at] + (" " if rng.random() < 0.2 else ""))
        rows.append((i, "".join(out), "abcd"[i % 4]))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spark):
    docs = made_up(spark)
    found = langid.identify(docs, langid.learn_filters(docs)).join(docs.select("doc_id", "lang"), "doc_id").where(langid.held_out())
    rows = found.collect()
    assert len(rows) > 50 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
    turned = docs.withColumn("lang", langid.F.when(langid.held_out(), langid.F.lit("a")).otherwise(langid.F.col("lang")))
    assert (langid.learn_filters(turned).slots == langid.learn_filters(docs).slots).all()


def test_masks_hold_the_sets(spark):
    docs = made_up(spark, 120)
    filters = langid.learn_filters(docs)
    counts = {}
    for r in docs.where(~langid.held_out()).collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        for g in langid.ngrams(data, np.array([0, len(data)]))[0].tolist():
            by = counts.setdefault(r.lang, {})
            by[g] = by.get(g, 0) + 1
    share = {lang: {g: n / sum(by.values()) for g, n in by.items()} for lang, by in counts.items()}
    wrong = total = 0
    for g in {g for by in counts.values() for g in by}:
        every = sum(s.get(g, 0) for s in share.values())
        want = {lang for lang, by in counts.items() if by.get(g, 0) >= min(langid.SEEN, max(by.values())) and share[lang][g] >= langid.SHARE * every}
        mask = np.uint64(2**64 - 1)
        for at in langid._probes(np.array([g], np.uint32)):
            mask &= filters.slots[0][at[0]]
        got = {lang for i, lang in enumerate(filters.languages) if int(mask) >> i & 1}
        assert want <= got
        wrong, total = wrong + len(got - want), total + 4
    assert wrong / total <= 0.01 + 2 * filters.false_positive.max()


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(i, "same words for two languages", "b" if i % 2 else "a") for i in range(40)], "doc_id bigint, text string, lang string")
    assert {r.lang_pred for r in langid.identify(docs, langid.learn_filters(docs)).collect()} == {"a"}
