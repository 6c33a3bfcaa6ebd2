"""The pipeline on the smallest tables, stage by stage against what each stage promises."""

import hashlib
import os
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_corpus import DOCS, PROSE, rows
from tokenizers import Tokenizer

import corpus_pipeline
from civicrill.llm import decontaminate, secrets, simhash, toxicity
from civicrill.llm.common import read

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_stages(spark):
    docs = read(spark, SMALL, "documents")
    columns = docs.columns
    bad = {r["doc_id"] for r in toxicity.detect(docs, read(spark, SMALL, "labels")).filter("toxic").collect()}
    stages = dict(corpus_pipeline.STAGES)
    a = stages["toxicity"](spark, docs, SMALL)
    assert a.columns == columns and {r["doc_id"] for r in a.collect()} == {r["doc_id"] for r in docs.collect()} - bad
    b = stages["near_duplicates"](spark, a, SMALL)
    assert {r["doc_id"] for r in b.collect()} == {r["component_id"] for r in simhash.near_duplicates(a).collect()}
    c = stages["decontamination"](spark, b, SMALL)
    hit = {r["doc_id"] for r in decontaminate.report(b, read(spark, SMALL, "benchmark")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in c.collect()} == {r["doc_id"] for r in b.collect()} - hit
    d = stages["secrets"](spark, c, SMALL)
    assert d.columns == columns and {r["doc_id"] for r in d.collect()} == {r["doc_id"] for r in c.collect()}
    live = {r["doc_id"]: r["n_live"] for r in secrets.scan(c).collect()}
    before = {r["doc_id"]: r["text"] for r in c.collect()}
    assert all((r["text"] != before[r["doc_id"]]) == (live[r["doc_id"]] > 0) for r in d.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in d.collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got.keys() == want.keys()
    assert all(got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() for k, ids in want.items())
    assert all(re.fullmatch("[0-9a-f]{64}", r["decoded_sha256"]) for r in got.values())


def tables(spark, folder, docs, labels, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, and columns named as results are."""
    data = [*rows(), rows()[5], (None, None, None, None, None), (None, "a text of no id at all", None, None, None), (3, "another text of the id three", "en", None, 1)]
    own = {c: F.lit("own") for c in ("fingerprint", "component_id", "toxic", "n_hit", "contaminated", "spans", "n_tokens", "ids", "decoded", "label")}
    docs = spark.createDataFrame(data, DOCS).withColumns(own).repartition(3)
    sf = tables(spark, tmp_path, docs, [(1, 1, 0), (None, 0, 1), (2, None, None), (3, 0, 0)], [(1, PROSE), (2, None), (None, "x"), (3, "")])
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == names
    # nothing is labelled toxic; copies of the benchmark's passage go with their near copies
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not any(PROSE in (t or "") for t in kept.values()) and {9, 10, 15, 16} <= kept.keys()
    got = corpus_pipeline.run(spark, sf)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r["doc_id"]) for r in docs.collect())
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in got.filter("doc_id in (9, 10)").collect():
        assert r["n_tokens"] == len(library.encode(kept[r["doc_id"]], add_special_tokens=False).ids)


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    sf = tables(spark, tmp_path, docs, [], [])
    got = corpus_pipeline.run(spark, sf)
    assert got.collect() == [] and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
