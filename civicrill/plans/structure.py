"""Structures that grow by rounds: reading order of pages, chains of amendments, searches split under a cap, histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicrill.functions.numbers import total
from civicrill.operators.chains import beginnings
from civicrill.operators.frontier import split_under_cap
from civicrill.operators.history import versions
from civicrill.operators.layout import DEPTH, HEADING_SLACK, MIN_ACROSS, MIN_DOWN, reading_order
from civicrill.plans.registry import query
from civicrill.plans.standins import CONTRACTS, contracts
from civicrill.sources.tables import table

# --- reading order: the lines of a supplier and quarter are the boxes of a page in three columns


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, box, x0, y0, x1, y1, heading; every line of every order is a box, headings span two columns."""
    q, day = F.col("l_quantity"), F.dayofyear("l_shipdate")
    heading = F.round(F.col("l_discount") * 100).isin(0, 10)
    x0, y0 = (F.col("l_linenumber") % 3) * 190 + q % 5, day * 4 + q % 3
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") * 100000 + F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("page"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + F.when(heading, 330).otherwise(140 + F.col("l_partkey") % 37)).alias("x1"),
        (y0 + 3 + q % 12).alias("y1"),
        heading.alias("heading"),
    )


BOXES = """boxes AS (
  SELECT l_suppkey * 100000 + year(l_shipdate) * 10 + quarter(l_shipdate) AS page, l_orderkey * 8 + l_linenumber AS box, round(l_discount * 100) IN (0, 10) AS heading,
    l_linenumber % 3 * 190 + l_quantity % 5 AS x0, dayofyear(l_shipdate) * 4 + l_quantity % 3 AS y0,
    l_linenumber % 3 * 190 + l_quantity % 5 + CASE WHEN round(l_discount * 100) IN (0, 10) THEN 330 ELSE 140 + l_partkey % 37 END AS x1,
    dayofyear(l_shipdate) * 4 + l_quantity % 3 + 3 + l_quantity % 12 AS y1
  FROM lineitem)"""


def _reach(axis: str) -> str:
    """Running reach of a region's body before a box, and the widest stretch with its middle."""
    return f"""MAX(CASE WHEN body THEN {axis}1 END) OVER (PARTITION BY page, path ORDER BY {axis}0, {axis}1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach_{axis}"""


def _widest(axis: str) -> str:
    gap = f"CASE WHEN body AND {axis}0 > reach_{axis} THEN {axis}0 - reach_{axis} END"
    middle = f"(({axis}0 + reach_{axis}) / 2)"
    return f"""coalesce(MAX({gap}) OVER w, 0) AS gap_{axis}, MIN(CASE WHEN {axis}0 - reach_{axis} = most_{axis} AND body THEN {middle} END) OVER w AS at_{axis}"""


@query(f"""WITH RECURSIVE {BOXES}, t AS (
  SELECT *, '' AS path, 0 AS level, true AS open FROM boxes WHERE page IS NOT NULL AND box IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL
  UNION ALL
  SELECT page, box, heading, x0, y0, x1, y1, path || CASE way WHEN 'x' THEN CAST(CAST(x0 >= at_x AS INTEGER) AS VARCHAR)
      WHEN 'y' THEN CAST(CAST(coalesce(next, y1) > at_y AS INTEGER) AS VARCHAR) ELSE '' END, level + 1, way IS NOT NULL
  FROM (
    WITH a AS (SELECT *, COUNT(*) FILTER (WHERE NOT heading) OVER (PARTITION BY page, path) > 0 AS plain FROM t WHERE open AND level <= {DEPTH}),
    b AS (SELECT *, NOT heading OR NOT plain AS body FROM a),
    c AS (SELECT *, {_reach('x')}, {_reach('y')} FROM b),
    m AS (SELECT *, MAX(CASE WHEN body THEN x0 - reach_x END) OVER (PARTITION BY page, path) AS most_x, MAX(CASE WHEN body THEN y0 - reach_y END) OVER (PARTITION BY page, path) AS most_y FROM c),
    d AS (SELECT *, {_widest('x')}, {_widest('y')} FROM m WINDOW w AS (PARTITION BY page, path)),
    e AS (SELECT *, CASE WHEN gap_x >= {MIN_ACROSS} AND (gap_x >= gap_y OR gap_y < {MIN_DOWN} OR NOT plain) THEN 'x' WHEN gap_y >= {MIN_DOWN} AND plain THEN 'y' END AS way FROM d),
    n AS (SELECT h.page AS n_page, h.box AS n_box, arg_min(k.y1, (k.y0, k.y1)) AS next FROM e h JOIN e k ON h.page = k.page AND h.path = k.path
      WHERE h.way = 'y' AND h.heading AND NOT k.heading AND k.y0 >= h.y1 - {HEADING_SLACK} AND k.x0 < h.x1 AND h.x0 < k.x1 GROUP BY 1, 2)
    SELECT * FROM e LEFT JOIN n ON n_page = page AND n_box = box))
SELECT page, box, row_number() OVER (PARTITION BY page ORDER BY path, y0, x0, box) AS place, length(path) AS depth FROM t WHERE NOT open OR level > {DEPTH}""")
def page_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN08, SC13: the order in which the boxes of a page are read, by recursive cuts."""
    return reading_order(page_boxes(spark, sf_dir), "page")


# --- amendments: a contract that is no expense amends the contract of its party before it, if that is near enough

MONTHS = 36


def amendment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, previous (null for an original, and where nothing of the party is near enough), party, amount, gap in months."""
    one = contracts(spark, sf_dir).filter("id is not null").groupBy("id").agg(F.min(F.struct("party", "signed", "amount", "direction")).alias("c"))  # a repeated id is one contract
    c = one.select("id", "c.*").withColumn("month", F.year("signed") * 12 + F.month("signed"))
    before = Window.partitionBy("party").orderBy("signed", "id")
    gap = F.col("month") - F.lag("month").over(before)
    previous = F.when((F.col("direction") != "expense") & (gap <= MONTHS), F.lag("id").over(before))
    return c.select("id", "party", "signed", "amount", previous.alias("previous"), F.when(previous.isNotNull(), gap).alias("gap"))


LINKS = f"""{CONTRACTS}, o AS (SELECT DISTINCT ON (id) id, party, signed, amount, direction, year(signed) * 12 + month(signed) AS m FROM contracts WHERE id IS NOT NULL ORDER BY id, party NULLS FIRST, signed NULLS FIRST, amount NULLS FIRST, direction),
g AS (SELECT *, lag(id) OVER w AS last_id, m - lag(m) OVER w AS apart FROM o WINDOW w AS (PARTITION BY party ORDER BY signed, id)),
links AS (SELECT id, party, signed, amount, CASE WHEN direction <> 'expense' AND apart <= {MONTHS} THEN last_id END AS previous, CASE WHEN direction <> 'expense' AND apart <= {MONTHS} THEN apart END AS gap FROM g)"""


@query(f"""WITH RECURSIVE {LINKS}, t AS (
  SELECT id, id AS root, 0 AS hops FROM links WHERE previous IS NULL UNION ALL SELECT links.id, root, hops + 1 FROM links JOIN t ON links.previous = t.id)
SELECT root, COUNT(*) - 1 AS amendments, CAST(MAX(amount) AS DOUBLE) AS valid_amount, CAST(SUM(amount) AS DOUBLE) AS naive_sum,
  string_agg(CAST(id AS VARCHAR), ',' ORDER BY hops, id) AS members, CAST(MAX(gap) AS BIGINT) AS widest_gap, CAST(MAX(signed) AS VARCHAR) AS last_signed
FROM t JOIN links USING (id) GROUP BY 1 HAVING COUNT(*) > 1""")
def amendment_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13: each original with its amendments in order. The highest amount of a chain is valid; the sum of all is its upper bound."""
    links = amendment_links(spark, sf_dir)
    places, _ = beginnings(links.select("id", "previous"), "id", "previous")
    members = links.join(places, "id").groupBy("root").agg(
        (F.count(F.lit(1)) - 1).alias("amendments"),
        F.max("amount").cast("double").alias("valid_amount"),
        total(F.col("amount")).alias("naive_sum"),
        F.sort_array(F.collect_list(F.struct("hops", "id"))).alias("m"),
        F.max("gap").cast("long").alias("widest_gap"),
        F.max("signed").cast("string").alias("last_signed"),
    )
    return members.filter("amendments > 0").withColumn("members", F.array_join(F.transform("m", lambda x: x["id"].cast("string")), ",")).drop("m")


# --- a register that answers at most CAP rows to a question, read in full by ever narrower questions

CAP = 40
#: The last figures of a key are the last resort, from the last one on.
NARROWER = ("status", "priority", "year", "month", "last_figure", "last_figures")


def _narrower(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    parts = (F.col("o_orderstatus"), F.col("o_orderpriority"), F.year("o_orderdate"), F.month("o_orderdate"), F.col("o_orderkey") % 10, F.col("o_orderkey") % 100)
    return o.select(*[c.alias(n) for c, n in zip(parts, NARROWER, strict=True)])


@query(f"""WITH RECURSIVE r AS (SELECT [coalesce(o_orderstatus, '?'), coalesce(o_orderpriority, '?'), coalesce(CAST(year(o_orderdate) AS VARCHAR), '?'), coalesce(CAST(month(o_orderdate) AS VARCHAR), '?'),
  coalesce(CAST(o_orderkey % 10 AS VARCHAR), '?'), coalesce(CAST(o_orderkey % 100 AS VARCHAR), '?')] AS v FROM orders),
t AS (SELECT 0 AS level, '' AS cell, v, (SELECT COUNT(*) FROM r) AS n FROM r
  UNION ALL SELECT level, cell, v, COUNT(*) OVER (PARTITION BY cell) FROM (SELECT level + 1 AS level, array_to_string(v[1:level + 1], '/') AS cell, v FROM t WHERE n > {CAP} AND level < {len(NARROWER)}))
SELECT level, cell, COUNT(*) AS n, CASE WHEN COUNT(*) <= {CAP} THEN 'fetched' ELSE 'over' END AS state FROM t WHERE n <= {CAP} OR level = {len(NARROWER)} GROUP BY 1, 2""")
def capped_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC18: the questions that together read a register whole, though each may have CAP answers only."""
    return split_under_cap(_narrower(spark, sf_dir), NARROWER, CAP)


# --- histories: the latest order of a customer in a year stands for a person's function in a yearly snapshot


def yearly_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer, year, state (of the latest order), priorities (all of the year, in order of their text), note (in some years)."""
    o = table(spark, sf_dir, "orders").filter("o_orderdate is not null")
    rows = o.select(F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("year"), F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderstatus", "o_orderpriority", "o_orderkey")
    note = F.when(F.min("o_orderkey") % 3 == 0, F.concat(F.lit("n"), F.min("o_orderkey").cast("string")))
    return rows.groupBy("customer", "year").agg(F.max_by("o_orderstatus", "at").alias("state"), F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"), note.alias("note"))


HISTORY = ("state",), ("priorities",), ("note",)


@query("""WITH s AS (SELECT o_custkey AS customer, year(o_orderdate) AS year, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS state,
  list_sort(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderpriority IS NOT NULL)) AS priorities, CASE WHEN MIN(o_orderkey) % 3 = 0 THEN 'n' || MIN(o_orderkey) END AS note FROM orders WHERE o_orderdate IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1, 2),
y AS (SELECT year, lead(year) OVER (ORDER BY year) AS following FROM (SELECT DISTINCT year FROM s)),
f AS (SELECT *, state IS NOT DISTINCT FROM lag(state) OVER w AND coalesce(lag(following) OVER w = year, false) AS same, arg_min(note, year) OVER w AS first_note FROM s JOIN y USING (year) WINDOW w AS (PARTITION BY customer ORDER BY year)),
v AS (SELECT *, SUM(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY customer ORDER BY year) AS version FROM f),
seen AS (SELECT customer, p, MIN(year) AS since FROM (SELECT customer, year, unnest(priorities) AS p FROM s) GROUP BY 1, 2),
g AS (SELECT customer, version, arg_min(state, year) AS state, arg_max(first_note, year) AS note, MIN(year) AS valid_from, MAX(year) AS last, CASE WHEN MAX(coalesce(following, 9999)) < 9999 THEN MAX(following) END AS valid_to FROM v GROUP BY 1, 2)
SELECT customer, any_value(state) AS state, coalesce(string_agg(p, ',' ORDER BY since, p), '') AS priorities, any_value(note) AS note, valid_from, any_value(valid_to) AS valid_to
FROM g LEFT JOIN seen USING (customer) WHERE since IS NULL OR since <= last GROUP BY customer, version, valid_from""")
def function_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN29: versions of a state with validity over the yearly snapshots; lists grow in order, notes made by hand stay."""
    v = versions(yearly_states(spark, sf_dir), "customer", "year", *HISTORY)
    return v.withColumn("priorities", F.array_join("priorities", ","))
