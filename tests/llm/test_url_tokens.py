"""Rules of URLs with more frequent tokens than any bound."""

import numpy as np

from tideline.llm import url_rules


def test_rules_of_tokens_beyond_the_twelfth(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(200):
        block = i % 2 == 0
        names = [f"t{k}" for k in range(14) if rng.random() < (0.97 if block else 0.35)]
        names += ["a", "b"] if block else ["a"] if i % 4 == 1 else ["b"]
        rows.append((f"http://{i}.net/?" + "&".join(f"{n}=1" for n in names), "block" if block else "allow"))
    mined = url_rules.mine_rules(spark.createDataFrame(rows, "url string, verdict string"), support=0.3).collect()
    # each of a and b tells less than the others, and both together tell all
    both = [r for r in mined if r.antecedent == ["query:a", "query:b"]]
    assert [(r.verdict, r.confidence, r.support) for r in both] == [("block", 1.0, 0.5)]
