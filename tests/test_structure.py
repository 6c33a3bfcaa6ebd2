"""Operators that work by rounds or by cells, against plain Python, on awkward rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from civicrill.functions.numbers import in_polygon
from civicrill.operators import chains, frontier, grid, history, layout
from civicrill.sources.shared import written


def test_chains_double_their_steps(spark):
    rng = random.Random(2)
    before = {i: (i - 1 if 0 < i < 41 else 41 if i > 41 and i % 3 else None) for i in range(90)}
    before[80], before[81] = 999, 80  # a pointer to no row begins a chain
    rows = [*before.items(), (None, 3)]
    rng.shuffle(rows)
    got, took = chains.beginnings(spark.createDataFrame(rows, "id long, b long").repartition(3), "id", "b")

    def walk(i, n=0):
        return walk(before[i], n + 1) if before[i] in before else (i, n)

    assert {r["id"]: (r["root"], r["hops"]) for r in got.collect()} == {i: walk(i) for i in before} and got.count() == len(before)
    assert took <= math.log2(40) + 1
    assert chains.beginnings(spark.createDataFrame([], "id long, b long"), "id", "b")[0].collect() == []
    with pytest.raises(ValueError):
        chains.beginnings(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, b long"), "id", "b", rounds=6)


@pytest.mark.parametrize("size", [0.7, 3.0, 50.0])
def test_grid_equals_a_test_of_every_pair(spark, size):
    """Areas of many cells and of less than one, concave, with holes, on cell edges; points on corners and without coordinates."""
    rng = random.Random(5)
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    star = ring(*[((9 if k % 2 else 3) * math.cos(k * math.pi / 7) + 4, (9 if k % 2 else 3) * math.sin(k * math.pi / 7) - 2) for k in range(14)])
    areas = [(1, [ring((0, 0), (12, 0), (12, 12), (0, 12)), ring((3, 3), (6, 3), (6, 6), (3, 6))]), (2, [star]), (3, [ring((-20.2, -9.1), (-20.1, -9.1), (-20.15, -9.0))]), (4, [ring((-30, -30), (40, -29), (40, 33.5))]), (5, []), (6, None)]
    points = [(i, rng.uniform(-25, 25), rng.uniform(-15, 15)) for i in range(1500)] + [(2000, 0.0, 0.0), (2001, 12.0, 12.0), (2002, 3.0, 3.0), (2003, None, 1.0), (None, -20.15, -9.05), (2004, 3.0, 4.0)]
    a = spark.createDataFrame(areas, "area long, rings array<array<struct<x:double,y:double>>>")
    p = spark.createDataFrame(points, "point long, x double, y double").repartition(3)
    want = sorted(map(tuple, p.crossJoin(a).filter(in_polygon(F.col("rings"), F.col("x"), F.col("y"))).select("point", "area").collect()), key=str)
    got = grid.points_in_areas(p, a, "point", "area", size)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 500
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_cells_hold_every_row_once(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), rng.choice([1, 2, None]), rng.randrange(4)) for _ in range(500)] + [("c", 9, 9)] * 60
    df = spark.createDataFrame(rows, "x string, y int, z int")
    got = [tuple(r) for r in frontier.split_under_cap(df, ["x", "y", "z"], 25).collect()]
    assert sum(r[2] for r in got) == len(rows) and len({r[1] for r in got}) == len(got)
    assert all((r[2] <= 25) == (r[3] == "fetched") for r in got) and ("c/9/9", 60, "over") in {r[1:] for r in got}
    assert [tuple(r) for r in frontier.split_under_cap(df, ["x"], 1000).collect()] == [(0, "", 560, "fetched")]
    assert frontier.split_under_cap(df.limit(0), ["x"], 5).collect() == []


STATES = "who string, at int, job string, roles array<string>, note string"
SEEN = [
    ("a", 1, "clerk", ["x"], None),
    ("a", 2, "clerk", ["y", "x"], "n1"),
    ("a", 3, "mayor", ["z"], "n2"),
    ("a", 5, "mayor", [], None),
    ("b", 2, None, None, None),
    ("b", 3, None, ["q"], "m"),
    ("b", 3, None, ["q"], "m"),
    ("c", 4, "clerk", ["x"], "k"),
    (None, 4, "clerk", ["x"], "k"),
    ("d", None, "clerk", ["x"], "k"),
]
WANT = {
    ("a", "clerk", "x,y", "n1", 1, 3),
    ("a", "mayor", "x,y,z", "n1", 3, 4),
    ("a", "mayor", "x,y,z", "n1", 5, None),
    ("b", None, "q", "m", 2, 4),
    ("c", "clerk", "x", "k", 4, 5),
}


def shown(df):
    rows = [(r["who"], r["job"], ",".join(r["roles"] or []), r["note"], r["valid_from"], r["valid_to"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_history_of_snapshots(spark):
    df = spark.createDataFrame(SEEN, STATES).repartition(3)
    assert shown(history.versions(df, "who", "at", ["job"], ["roles"], ["note"])) == WANT
    assert history.versions(df.limit(0), "who", "at", ["job"]).collect() == []


def test_history_grows_by_snapshots_and_not_by_the_same_again(spark):
    df = spark.createDataFrame(SEEN, STATES)
    grown = history.versions(df.filter("at = 1"), "who", "at", ["job"], ["roles"], ["note"])
    for at in (2, 3, 4, 5):
        day = df.filter(F.col("at") == at).drop("at")
        grown = written(history.merged(grown, day, "who", F.lit(at), ["job"], ["roles"], ["note"]), "history")
        again = history.merged(grown, day, "who", F.lit(at), ["job"], ["roles"], ["note"])
        assert shown(again) == shown(grown)
    assert shown(grown) == WANT


def boxes(spark, rows):
    return spark.createDataFrame(rows, "page int, box int, x0 double, y0 double, x1 double, y1 double, heading boolean").repartition(2)


def test_reading_order(spark):
    """Two columns under a heading of both, a heading over the second column alone, and a foot; a page of headings; nulls."""
    page = [
        (1, 1, 0, 0, 200, 10, True),
        (1, 2, 0, 20, 90, 40, False),
        (1, 3, 0, 44, 90, 60, False),
        (1, 4, 110, 20, 200, 30, False),
        (1, 5, 110, 40, 200, 44, True),
        (1, 6, 110, 46, 200, 60, None),
        (1, 7, 0, 80, 200, 90, False),
    ]
    others = [(2, 1, 50, 0, 60, 5, True), (2, 2, 0, 0, 10, 5, True), (3, 1, 0, 0, 1, 1, False), (3, 1, 0, 0, 1, 1, False), (3, 2, None, 0, 1, 1, False), (None, 1, 0, 0, 1, 1, False)]
    rows = [tuple(float(v) if 2 <= i < 6 and v is not None else v for i, v in enumerate(r)) for r in page + others]
    got = layout.reading_order(boxes(spark, rows), "page").orderBy("page", "place").collect()
    assert [r["box"] for r in got if r["page"] == 1] == [1, 2, 3, 4, 5, 6, 7]
    assert [r["box"] for r in got if r["page"] == 2] == [2, 1] and [r["box"] for r in got if r["page"] == 3] == [1, 1] and len(got) == 11
    assert layout.reading_order(boxes(spark, []), "page").collect() == []


def test_reading_order_shuffles_boxes_once(spark):
    """Repeated boxes, of which one is a heading, and pages longer than a batch; a heading carries no list of what is below it."""
    rng = random.Random(11)
    rows = []
    for p, n in ((1, 40), (2, 25), (3, 700), (4, 1), (5, 60)):
        for _ in range(n):
            x, y = float(rng.randrange(3) * 190 + rng.randrange(5)), float(rng.randrange(n * 16))
            rows.append((p, rng.randrange(n) if p == 5 else len(rows), x, y, x + rng.choice((140.0, 330.0)), y + rng.randrange(3, 15), rng.random() < 0.2))
    df = boxes(spark, rows)
    want = layout.reading_order(df, "page").orderBy("page", "place").collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        spark.sparkContext.setJobGroup("reading", "")
        got = layout.reading_order(df, "page")
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("reading")  # no rounds, nothing is written on the way
        assert got.orderBy("page", "place").collect() == want and len(want) == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Join" not in plan
