"""Readers, writers and streams on small files."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civicrill.sources import files, sinks
from civicrill.streaming import weekly

MEETING = T.StructType().add("organ", "string").add("number", "integer").add("body", T.ArrayType(T.StructType().add("id", "string").add("amount", "long")))


def test_json_tree_quarantines(spark, tmp_path):
    for organ, name, text in (("council", "1.json", json.dumps({"organ": "council", "number": 1, "body": [{"id": "a", "amount": None}, {"id": "b", "amount": 0}]})), ("board", "2.json", "{broken"), ("board", "3.json", json.dumps({"organ": "board", "number": 3, "body": []}))):
        (tmp_path / organ).mkdir(exist_ok=True)
        (tmp_path / organ / name).write_text(text)
    good, broken = files.json_tree(spark, str(tmp_path), MEETING, ("folder",))
    assert sorted((r["folder"], r["number"]) for r in good.collect()) == [("board", 3), ("council", 1)]
    assert [r["path"].rsplit("/", 1)[1] for r in broken.collect()] == ["2.json"]
    points = good.select("folder", F.explode_outer("body").alias("b")).collect()
    assert {(r["folder"], r["b"]["id"], r["b"]["amount"]) if r["b"] else (r["folder"],) for r in points} == {("council", "a", None), ("council", "b", 0), ("board",)}
    assert files.json_or_none(spark, str(tmp_path / "none.json"), MEETING)[1] == "missing"


def test_delimited(spark, tmp_path):
    (tmp_path / "x.psv").write_text("1|a|01:Firm: one;02:Two\n2|b\n\n3|c|x|too long\n")
    rows, long = files.delimited(spark, str(tmp_path / "x.psv"), ["id", "name", "parties"])
    got = {r["id"]: r for r in rows.withColumn("p", files.parties(F.col("parties"))).collect()}
    assert [tuple(x) for x in got["1"]["p"]] == [("01", "Firm: one"), ("02", "Two")] and got["2"]["parties"] == "" and long.count() == 1


def test_csv_headers_xml_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("long title: A;other, title:B;third: C\n1;2;3\n")
    assert files.short_headers(files.sniffed_csv(spark, str(tmp_path / "a.csv"))).first().asDict() == {"A": "1", "B": "2", "C": "3"}
    (tmp_path / "a.xml").write_text("<root><row><k>1</k></row><row><k>2</k></row></root>")
    assert sorted(r["k"] for r in files.xml_rows(spark, str(tmp_path / "a.xml"), "row", "k int").collect()) == [1, 2]
    (tmp_path / "t.bin").write_bytes("Žluť".encode("cp1250"))
    df = spark.read.format("binaryFile").load(str(tmp_path / "t.bin"))
    assert df.select(files.decoded(F.col("content")).alias("t"), files.kind_by_bytes(F.col("content")).alias("k")).first().asDict() == {"t": "Žluť", "k": "text"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for m in ("xml/T1.xml", "csv/T1.csv", "csv_od/t1.csv", "xml/T2.xml", "readme.txt"):
            z.writestr(m, m)
    best = files.best_form(files.archive_members(spark, str(tmp_path)))
    assert sorted(bytes(r["content"]).decode() for r in best.collect()) == ["csv_od/t1.csv", "xml/T2.xml"]


def test_status(spark):
    found, expected = spark.createDataFrame([("a",), ("c",)], "k string"), spark.createDataFrame([("a",), ("b",)], "k string")
    assert {r["k"]: r["status"] for r in files.source_status(found, expected, "k").collect()} == {"a": "ok", "b": "missing", "c": "unexpected"}
    with pytest.raises(ValueError, match="b"):
        files.require(found, expected, "k")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 1.5)], "k string, n int, x double")
    sinks.by_entity(df, str(tmp_path / "t"), "k")
    sinks.by_entity(df.filter("k = 'a'"), str(tmp_path / "t"), "k")
    assert [p.name for p in (tmp_path / "t").iterdir() if p.is_dir()] == ["k=a"]
    sinks.public_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    geo = json.loads(sinks.feature_collection(df.withColumn("g", F.struct(F.lit("Point").alias("type"), F.array("x", "x").alias("coordinates"))), "g", "layer", "CC0").first()["json"])
    assert [f["properties"]["k"] for f in geo["features"]] == ["a", "b"] and geo["licence"] == "CC0"
    log = str(tmp_path / "log")
    assert sinks.logged(spark, log, "good", lambda: df, str(tmp_path / "o")) and not sinks.logged(spark, log, "bad", lambda: spark.table("no_such_table"), str(tmp_path / "p"))
    assert {r["name"]: (r["ok"], r["rows"]) for r in spark.read.parquet(log).collect()} == {"good": (True, 2), "bad": (False, 0)}


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "2024-01-01 10:00:00", 1, "view", 1.0), (2, "2024-01-04 10:00:00", 1, "click", 2.0), (2, "2024-01-04 10:00:00", 1, "click", 2.0), (3, "2024-01-20 10:00:00", 2, "view", 3.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumns({"ts": F.col("ts").cast("timestamp"), "props": F.lit("{}")})
    df.coalesce(1).write.parquet(str(src))
    stream = weekly.events(spark, str(src), "*.parquet")
    weekly.run_available(weekly.weekly(stream), str(tmp_path / "w"), str(tmp_path / "c1"), "complete")
    batch = weekly.weekly(spark.read.parquet(str(src)))
    key = lambda d: sorted((str(r["start"]), r["event_type"], r["items"], r["value"]) for r in d.collect())
    assert key(spark.read.parquet(str(tmp_path / "w"))) == key(batch)
    weekly.run_available(weekly.first_sightings(stream), str(tmp_path / "d"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3
    weekly.run_available(weekly.changes(stream), str(tmp_path / "s"), str(tmp_path / "c3"))
    assert [(r["before"], r["after"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [("view", "click")]
