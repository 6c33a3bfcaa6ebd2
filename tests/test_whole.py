"""Queries over whole tables: no subset of ids, remainders or line numbers."""

import pytest
from pyspark.sql import functions as F

from civicrill import catalogue

SMALL = "/root/testdata/sf0.001"
WHOLE = ("identity_resolution", "organ_matching", "abbreviated_names", "grants_per_recipient", "term_overlap", "interval_islands")


@pytest.mark.parametrize("name", WHOLE)
def test_sql_of_the_whole_has_no_subset(name):
    sql = catalogue.ORACLE[name]
    assert not any(x in sql for x in ("c_custkey <", "p_partkey <", "o_orderkey %", "user_id % 3 =", "l_linenumber >"))


def test_every_row_counts(spark):
    run = lambda name: catalogue.QUERIES[name](spark, SMALL)
    rows = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    assert run("grants_per_recipient").agg(F.sum("grants")).first()[0] == rows("orders").count()
    assert run("interval_islands").agg(F.sum("parts")).first()[0] == rows("lineitem").count()
    assert run("identity_resolution").count() == rows("supplier").count()
    assert run("organ_matching").count() == rows("part").select(F.col("p_size") % 30).distinct().count()
    assert run("abbreviated_names").filter("id % 3 = 2 or id >= 400").count() > 0 and run("abbreviated_names").filter("id % 3 = 0").count() == 0


def test_money_in_documents(spark, tmp_path):
    data = [(1, "ve výši 397.951,0 tis. Kč " + "slovo " * 5000 + "a 450 000 Kč"), (2, "bez částky"), (3, None), (4, "slovo " * 5000 + "3 mil. Kč, dříve 2,5 mil. Kč")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["amount"] for r in catalogue.QUERIES["money_in_documents"](spark, str(tmp_path)).collect()}
    assert {k: v if v is None else float(v) for k, v in got.items()} == {1: 397951000.0, 2: None, 3: None, 4: 3000000.0}


def test_tokens_of_one_document_have_a_weight(spark, tmp_path):
    spark.createDataFrame([(1, "river meadow"), (2, "river")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["token"]: (r["df"], float(r["share"])) for r in catalogue.QUERIES["idf_weights"](spark, str(tmp_path)).collect()}
    assert got == {"river": (2, 1.0), "meadow": (1, 0.5)}
