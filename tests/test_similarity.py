"""Weighted overlap against all pairs, with tokens that many documents carry."""

import random

import pytest
from pyspark.sql import functions as F

from civicrill import catalogue
from civicrill.operators.text_match import frequencies, weighted_jaccard
from civicrill.plans import texts
from civicrill.plans.texts import WEIGHT
from compare import differences


def test_weighted_jaccard_finds_frequent_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i:03d}" for i in range(120)]
    items = {i: set(rng.sample(words, 8)) for i in range(12)}
    docs = {}
    for d in range(400):
        base = items[d % 4] if d % 2 else set(rng.sample(words[:40], rng.randint(1, 12)))
        docs[d] = base | set(rng.sample(words, d // 2 % 5 * 3))
    table = lambda m, k: spark.createDataFrame([(k_, t) for k_, ts in m.items() for t in ts], f"{k} long, token string")
    n = {t: sum(t in ts for ts in docs.values()) for t in words}
    w = {t: 8 if c <= 2 else 5 if c <= 10 else 3 if c <= 50 else 1 for t, c in n.items() if c}
    total = lambda ts: sum(w.get(t, 0) for t in ts)
    b = table(docs, "doc_id")
    for least in (0.15, 0.6):
        want = {}
        for i, p in items.items():
            for d, q in docs.items():
                o = total(p & q)
                if o and o / (total(p | q)) >= least:
                    want[i, d] = (len([t for t in p & q if t in w]), o, pytest.approx(o / total(p | q)))
        got = {(r["item_id"], r["doc_id"]): (r["shared"], r["overlap"], r["similarity"]) for r in weighted_jaccard(table(items, "item_id"), b, "item_id", "doc_id", frequencies(b, "doc_id"), least, F.expr(WEIGHT)).collect()}
        assert got == want
        # copies of an item beyond any cap on frequencies
        assert sum(all(n[t] > 40 for t in items[i] & docs[d]) for i, d in want) > 40


@pytest.mark.parametrize("copies", [39, 40, 41, 60])
def test_weighted_jaccard_pairs_need_a_rare_token(spark, tmp_path, copies):
    said = "meadow harvest lantern bridge"
    docs = [(i, said) for i in range(copies)] + [(1000 + i, f"granite orchard number{i}") for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d")
    spark.createDataFrame([(1, said), (2, "granite orchard")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/b")
    for folder, name in (("d", "documents"), ("b", "benchmark")):
        next((tmp_path / folder).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    assert differences(spark, str(tmp_path), texts.weighted_jaccard_pairs, catalogue.ORACLE["weighted_jaccard_pairs"]) == ""
    assert texts.weighted_jaccard_pairs(spark, str(tmp_path)).filter("item_id = 1").count() == (copies if copies <= 40 else 0)
