"""Search, persons, speakers, streams, coordinates and collation against plain Python, on awkward rows."""

import collections
import datetime as dt
import math
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from civicrill.functions.geodesy import ALLOWED, KNOWN, metres, world
from civicrill.operators import collation, mentions, search
from civicrill.streaming import recent
from civicrill.streaming.weekly import EVENT

TEXTS = ["The river, the mill and the old river road.", "Mill road", "", None, "the river the river the river", "x" * 40_000 + " river", "Old mill; old road; old river", "ŘEKA řeka Řeky"]


@pytest.fixture(scope="module")
def archive(spark):
    rows = [(i, t, "en" if i % 2 else "cs") for i, t in enumerate(TEXTS)] + [(None, "the river", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("length", F.lit("own")).repartition(3)
    return docs, search.write_index(docs, "doc_id", buckets=4)


ASKED = [(1, "the river"), (2, "old mill road"), (3, "nothing like it"), (4, ""), (5, None), (6, "river river"), (7, "the river the"), (None, "mill"), (8, "řeka")]


def plain_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def test_ranking(spark, archive):
    docs, index = archive
    lists = {i: plain_words(t) for i, t in enumerate(TEXTS)}
    mean = sum(map(len, lists.values())) / len(lists)
    want = set()
    for q, t in ASKED:
        scored = []
        for i, ws in lists.items():
            score, found = 0, 0
            for w in set(plain_words(t)):
                df = sum(w in x for x in lists.values())
                if n := ws.count(w):
                    score += round(math.log(1 + (len(lists) - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean)) * 1e9)
                    found += 1
            if found and q is not None:
                scored.append((-round(score / 1e9, 6), i, found))
        want |= {(q, i, -s, f, rank) for rank, (s, i, f) in enumerate(sorted(scored)[:3], 1)}
    asked = spark.createDataFrame(ASKED, "q long, text string")
    got = search.ranked(index, asked, "q", "doc_id", 3, buckets=4)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 8
    counts = collections.Counter((q, "en" if i % 2 else "cs") for q, i, *_ in want)
    assert {(r["q"], r["lang"]): r["hits"] for r in search.facets(got, docs, "q", "doc_id", "lang").collect()} == counts
    none = search.write_index(docs.limit(0), "doc_id")
    assert search.ranked(none, asked, "q", "doc_id", 3).collect() == []


def test_phrases(spark, archive):
    want = set()
    for q, t in ASKED:
        p = plain_words(t)
        for i, x in enumerate(TEXTS):
            ws = plain_words(x)
            at = [k for k in range(len(ws) - len(p) + 1) if p and ws[k : k + len(p)] == p]
            if at and q is not None:
                want.add((q, i, len(at), at[0]))
    got = search.phrases(archive[1], spark.createDataFrame(ASKED, "q long, text string"), "q", "doc_id", buckets=4)
    assert {tuple(r) for r in got.collect()} == want and (7, 4, 2, 0) in want


PERSONS = [(1, "Petr", "Novák"), (2, "Jana", "Kalina"), (3, "Karel", "Kalina"), (4, "Petr", "Dan"), (5, "Petr", "Dan"), (6, None, "Bez"), (7, "Adam", None), (None, "Ivan", "Kos"), (8, "Ota", "Hroch")]


def test_mentions(spark):
    who = spark.createDataFrame(PERSONS, "person long, given string, surname string")
    texts = [
        (1, "Petr Novák a Petra Nováka, s Petrem Novákem; jana kalina ne. Janu Kalinu ano, Karlem Kalinou ne"),
        (2, "Petr Dan nikdo, Petr Novákovi ne, Petr\nNovák ano"),
        (3, None),
        (4, ""),
        (None, "Petr Novák"),
        (5, "Ota Hroch " * 3000),
        (6, "Jany Kaliny, Petr Novák, Petr Novák"),
    ]
    got = mentions.mentions(spark.createDataFrame(texts, "id long, text string").repartition(3), who, "id", "person")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 3, 1), (1, 2, 1, 2), (2, 1, 1, 1), (5, 8, 3000, 1), (6, 1, 2, 1), (6, 2, 1, 2)}
    assert mentions.mentions(spark.createDataFrame(texts, "id long, text string"), who, "id", "person", most=1).filter("id = 6").count() == 1
    assert mentions.mentions(spark.createDataFrame([], "id long, text string"), who, "id", "person").collect() == []


def test_speakers(spark):
    who = spark.createDataFrame(PERSONS, "person long, given string, surname string")
    talk = ["úvod", "Slovo má pan zastupitel Novák.", "mluvím", "Děkuji, slovo má paní Kalina", "Prosím pana Hrocha", "Slovo má pan Dan. Prosím pana Nováka", None, "Vystoupí Nikdo"]
    rows = [("a", i, t) for i, t in enumerate(talk)] + [("b", 0, "bez volání"), (None, 1, "Slovo má pan Novák"), ("b", None, "Slovo má pan Novák")]
    got = mentions.speakers(spark.createDataFrame(rows, "t string, at int, text string").repartition(3), who, "t", "at", "person")
    assert {(r["t"], r["at"]): r["person"] for r in got.collect()} == {**{("a", i): p for i, p in enumerate([None, 1, 1, 1, 8, 1, 1, 1])}, ("b", 0): None}


def test_recent_changes_with_late_and_repeated_events(spark, tmp_path):
    """Batches one after another with one state: what is late or comes again changes nothing; lists stay short."""
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    event = lambda i, t, u, k: (i, t, u, k, 1.0, "{}")
    first = [event(i, day(1, i), 1, "ab"[i % 2]) for i in range(12)] + [event(50, day(1), 2, "a"), event(51, None, 2, "b"), event(52, day(2), 2, None)]
    second = [event(11, day(1, 11), 1, "b"), event(90, day(1, 3), 1, "c"), event(60, day(20), 1, "a"), event(61, day(3), 2, "b"), event(61, day(3), 2, "b")]
    rows = []
    for n, batch in enumerate((first, second)):
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        got = recent.drained(recent.recent_changes(stream), spark, f"{tmp_path}/state", f"{tmp_path}/out")
        rows.append({(r["user_id"], r["event_id"]): (r["before"], r["after"], r["kept"], r["oldest"]) for r in got.collect()})
        assert got.count() == len(rows[n])
    assert {k: v[2] for k, v in rows[0].items()} == {(1, i): min(i, recent.KEEP) for i in range(1, 12)}
    assert rows[1].items() - rows[0].items() == {((1, 60), ("b", "a", 1, day(20))), ((2, 61), ("a", "b", 1, day(3)))}


def test_recent_changes_ask_the_store_once_a_key():
    """Two batches of one key: one question and one answer each, whatever the number of events; rows as over the whole list."""
    calls = []

    class Store:
        value = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

    day = 24 * 3600 * 10**6
    events = [(i * day // 2, i, "aabbcab"[i % 7]) for i in range(300)]
    changes = [(t, i, before[2], kind) for before, (t, i, kind) in zip(events, events[1:], strict=False) if kind != before[2]]
    times = [[t for t, *_ in changes[max(0, n - recent.KEEP + 1) : n + 1] if t > changes[n][0] - 7 * day] for n in range(len(changes))]
    processor = recent._processor()
    processor.init(Store())
    got = []
    for batch in (events[:150], events[100:]):
        got += processor.handleInputRows((9,), iter([Row(user_id=9, ts=t, event_id=i, event_type=k) for t, i, k in reversed(batch)]), None)
    assert calls == ["get", "update"] * 2
    assert [tuple(r) for r in got] == [(9, i, t, before, after, len(k), k[0]) for (t, i, before, after), k in zip(changes, times, strict=True)]


def test_known_place(spark):
    df = spark.createDataFrame([KNOWN[0], (0.0, 0.0), (None, 1.0)], "east double, north double")
    got = [r["at"] for r in df.select(world(F.col("east"), F.col("north")).alias("at")).collect()]
    assert got[1] is None and got[2] is None
    assert df.limit(1).select(metres(world(F.col("east"), F.col("north")), KNOWN[1])).first()[0] < ALLOWED


CZECH = ["Adam", "Ágnes", "Cibule", "Čáp", "Dům", "Hrad", "chata", "Chyba", "Ibis", "Rak", "Řeka", "Sýr", "Šíp", "Zub", "Žák"]


def test_czech_order(spark):
    df = spark.createDataFrame([(n, i) for i, n in enumerate(reversed(CZECH))] + [("Adam", 99)], "name string, id int").repartition(5)
    got = collation.placed(df, "name", "id")
    assert [r["name"] for r in got.orderBy("place").collect()] == ["Adam", *CZECH] and sorted(r["place"] for r in got.collect()) == list(range(1, 17))
    found = {r["initial"]: r["names"] for r in collation.initials(df, "name").collect()}
    assert found == {"A": 3, "C": 1, "Č": 1, "D": 1, "H": 1, "CH": 2, "I": 1, "R": 1, "Ř": 1, "S": 1, "Š": 1, "Z": 1, "Ž": 1}
    assert collation.placed(df.limit(0), "name").collect() == []
    one = spark.createDataFrame([("Řeka",), ("REKA",), ("rak",)], "name string").groupBy(F.collate("name", collation.CZECH_PLAIN)).count()
    assert one.count() == 3


def test_scores_and_phrases_fold_by_document(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma w{i % 7}") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, "alpha beta gamma") for i in range(9)], "item_id long, text string")
    index = search.write_index(docs, "doc_id", buckets=4)
    ranked, phrases = search.ranked(index, asked, "item_id", "doc_id", 3, buckets=4), search.phrases(index, asked, "item_id", "doc_id", buckets=4)
    # no row for each question and document, or for each position, is shuffled before it is folded
    for found, folded in ((ranked, r"hashpartitioning\(item_id#\d+L?, doc_id#"), (phrases, r"explode\(positions")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(doc_id#" in plan and not re.search(folded, plan)
        assert found.select("item_id").distinct().count() == 9
