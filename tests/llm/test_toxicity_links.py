"""The features of each link of the toxicity chain against brute force, and held-out ranking by each link."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from civicrill.llm import toxicity
from civicrill.llm.common import read

TABLES = "/root/testdata/sf0.01"


def test_features_of_each_category(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 8)
    monkeypatch.setattr(toxicity, "MIN_ROWS", 2)
    rng = np.random.default_rng(1)
    rows = [([f"=w{j}" for j in range(12) if rng.random() < 0.4], (None, 0, 1)[rng.integers(3)], int(rng.integers(2)), 1) for _ in range(60)]
    want = []
    for y in (1, 2, 3):
        known = [r for r in rows if r[y] is not None]
        k = sum(r[y] for r in known)
        if k == len(known):
            continue  # one class alone chooses none
        share, scored = k / len(known), []
        for f in sorted({f for r in rows for f in r[0]}):
            own = [r[y] for r in known if f in r[0]]
            if own and sum(f in r[0] for r in rows) >= 2:
                e = len(own) * share
                scored.append((-((sum(own) - e) ** 2) / (e * (1 - share) * (1 - len(own) / len(known)) + 1e-9), f))
        want += [f for _, f in sorted(scored)[: 8 // 3] if f not in want]
    df = spark.createDataFrame(rows, "features array<string>, a int, b int, c int").repartition(3)
    assert toxicity.choose(df, ["a", "b", "c"]) == want
    assert toxicity.choose(df.limit(0), ["a", "b"]) == []


def test_shape():
    assert toxicity.shape("") == [] and toxicity.features(None) == set()
    got = set(toxicity.shape("A ### a a a a a a a a a\nx\nx"))
    assert {"#words8", "#capitals0.02", "#lines0.3", "#distinct0.3", "#triples0.5", "#symbols0.2"} <= got
    assert "#words16" not in got and "#capitals0.05" not in got and "#lines0.4" not in got
    assert len(toxicity.shape("word " * 400_000)) > 11


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_each_link_ranks_texts_that_it_has_not_seen(spark):
    docs, labels = read(spark, TABLES, "documents"), read(spark, TABLES, "labels")
    held = F.pmod(F.xxhash64("text"), F.lit(3)) == 0
    chain = toxicity.train(docs.filter(~held), labels)
    rows = toxicity.score(docs.filter(held), chain).drop("toxic").join(labels, "doc_id").collect()

    def auc(of, is_one):
        one, zero = ([r[of] for r in rows if is_one(r) is x] for x in (True, False))
        return np.mean([(a > b) + (a == b) / 2 for a in one for b in zero])

    assert auc("p_low_quality", lambda r: r["quality"] == 0) >= 0.8 and auc("p_toxic", lambda r: r["toxic"] == 1) >= 0.8
