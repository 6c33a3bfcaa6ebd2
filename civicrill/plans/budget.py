"""Budgets, statements and series: rollups that keep unknown apart from zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civicrill.functions.numbers import exact, ratio, total
from civicrill.operators.keyed import first_by, islands, top_k
from civicrill.plans.registry import query
from civicrill.sources.tables import table

#: Ledger stand-in: a four-digit code of flag, status and quantity; price below 5000 is unknown.
LEDGER = """ledger AS (SELECT CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END || CASE l_linestatus WHEN 'F' THEN '1' ELSE '2' END || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 2, '0') AS code,
  CAST(year(l_shipdate) AS BIGINT) AS year, month(l_shipdate) AS month, l_suppkey AS org,
  CASE WHEN l_extendedprice >= 5000 THEN CAST(l_extendedprice AS DECIMAL(18,2)) END AS plan, CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) END AS actual FROM lineitem)"""


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code (four digits), year, month, org, plan and actual (either may be unknown)."""
    li = table(spark, sf_dir, "lineitem")
    code = F.concat(
        F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "2").otherwise("3"),
        F.when(F.col("l_linestatus") == "F", "1").otherwise("2"),
        F.lpad(F.col("l_quantity").cast("int").cast("string"), 2, "0"),
    )
    price = F.col("l_extendedprice")
    return li.select(
        code.alias("code"),
        F.year("l_shipdate").cast("long").alias("year"),
        F.month("l_shipdate").alias("month"),
        F.col("l_suppkey").alias("org"),
        F.when(price >= 5000, exact(price)).alias("plan"),
        F.when(F.col("l_discount") > 0, exact(price) * (1 - F.col("l_discount").cast("decimal(4,2)"))).alias("actual"),
    )


@query(f"""WITH {LEDGER}, r AS (SELECT year, c1, c2, code, SUM(plan) AS s, SUM(plan) FILTER (WHERE code NOT LIKE '%50') AS net, grouping(c2, code) AS g FROM (SELECT *, substr(code, 1, 1) AS c1, substr(code, 1, 2) AS c2 FROM ledger) GROUP BY GROUPING SETS ((year, c1), (year, c1, c2), (year, c1, c2, code)))
SELECT year, coalesce(code, c2, c1) AS item, CASE g WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 4 END AS digits, CAST(s AS DOUBLE) AS total, CAST(net AS DOUBLE) AS without_transfers, CAST(s AS DOUBLE) / CAST(SUM(s) OVER (PARTITION BY year, g) AS DOUBLE) AS share FROM r""")
def budget_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, AG12: three levels of codes with and without transfers, shares of the level's own base."""
    l = ledger(spark, sf_dir).withColumns({"c1": F.substring("code", 1, 1), "c2": F.substring("code", 1, 2)})
    r = l.groupingSets([["year", "c1"], ["year", "c1", "c2"], ["year", "c1", "c2", "code"]], "year", "c1", "c2", "code").agg(F.sum("plan").alias("s"), F.sum(F.when(~F.col("code").endswith("50"), F.col("plan"))).alias("net"))
    digits = F.when(F.col("c2").isNull(), 1).when(F.col("code").isNull(), 2).otherwise(4)
    base = F.sum("s").over(Window.partitionBy("year", "digits"))
    return r.withColumn("digits", digits.cast("long")).select("year", F.coalesce("code", "c2", "c1").alias("item"), "digits", F.col("s").cast("double").alias("total"), F.col("net").cast("double").alias("without_transfers"), ratio(F.col("s"), base).alias("share"))


@query(f"""WITH {LEDGER}, t AS (SELECT year, substr(code, 1, 2) AS section, SUM(plan) AS p, SUM(actual) AS a FROM ledger GROUP BY 1, 2), d AS (SELECT *, a - p AS diff, row_number() OVER (PARTITION BY year ORDER BY abs(a - p) DESC NULLS LAST, section) AS place FROM t)
SELECT year, section, CAST(p AS DOUBLE) AS plan, CAST(a AS DOUBLE) AS actual, CAST(diff AS DOUBLE) AS deviation, CAST(a AS DOUBLE) / CAST(p AS DOUBLE) AS fulfilment, place FROM d WHERE place <= 4""")
def plan_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14: largest deviations of each year; a difference with an unknown side is unknown."""
    t = ledger(spark, sf_dir).groupBy("year", F.substring("code", 1, 2).alias("section")).agg(F.sum("plan").alias("p"), F.sum("actual").alias("a"))
    top = top_k(t, ["year"], 4, F.abs(F.col("a") - F.col("p")).desc_nulls_last(), F.col("section"))
    return top.select("year", "section", F.col("p").cast("double").alias("plan"), F.col("a").cast("double").alias("actual"), (F.col("a") - F.col("p")).cast("double").alias("deviation"), ratio(F.col("a"), F.col("p")).alias("fulfilment"), F.col("rank").cast("long").alias("place"))


@query(f"""WITH {LEDGER} SELECT code, year, org % 5 AS unit, CAST(SUM(plan) AS DOUBLE) AS plan, CAST(SUM(actual) AS DOUBLE) AS actual, CAST(SUM(actual) - SUM(plan) AS DOUBLE) AS difference, COUNT(*) AS lines, COUNT(plan) AS known FROM ledger GROUP BY 1, 2, 3""")
def null_preserving_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG11: the sum of known values; all unknown stays unknown, and so does a difference with it."""
    g = ledger(spark, sf_dir).groupBy("code", "year", (F.col("org") % 5).alias("unit"))
    return g.agg(total(F.col("plan")).alias("plan"), F.sum("actual").cast("double").alias("actual"), (F.sum("actual") - F.sum("plan")).cast("double").alias("difference"), F.count(F.lit(1)).alias("lines"), F.count("plan").alias("known"))


@query(f"""WITH {LEDGER} SELECT org, year, CAST(SUM(plan) FILTER (WHERE code LIKE '11%') AS DOUBLE) AS cash, CAST(SUM(plan) FILTER (WHERE code LIKE '21%') AS DOUBLE) AS loans_short, CAST(SUM(plan) FILTER (WHERE code LIKE '22%') AS DOUBLE) AS loans_long,
 CAST(CASE WHEN COUNT(plan) FILTER (WHERE code LIKE '2%') > 0 THEN SUM(plan) FILTER (WHERE code LIKE '2%') END AS DOUBLE) AS loans FROM ledger GROUP BY 1, 2""")
def code_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG15: codes of a balance sheet as columns; loans are the sum of two lines, unknown only if both are."""
    p = ledger(spark, sf_dir).withColumn("c2", F.substring("code", 1, 2)).groupBy("org", "year").pivot("c2", ["11", "12", "21", "22", "31", "32"]).agg(F.sum("plan"))
    loans = F.when(F.col("21").isNotNull() | F.col("22").isNotNull(), F.coalesce("21", F.lit(0)) + F.coalesce("22", F.lit(0)))
    return p.select("org", "year", F.col("11").cast("double").alias("cash"), F.col("21").cast("double").alias("loans_short"), F.col("22").cast("double").alias("loans_long"), loans.cast("double").alias("loans"))


@query(f"""WITH {LEDGER}, r AS (SELECT org, year, SUM(plan) AS revenue FROM ledger WHERE code LIKE '1%' AND month > 6 GROUP BY 1, 2), c AS (SELECT org, year, SUM(actual) AS cost, CASE WHEN COUNT(*) % 3 = 0 THEN SUM(plan) END AS reported FROM ledger WHERE code LIKE '2%' AND month <= 6 GROUP BY 1, 2)
SELECT org, year, CAST(revenue AS DOUBLE) AS revenue, CAST(cost AS DOUBLE) AS cost, coalesce(CAST(reported AS DOUBLE), CAST(revenue - cost AS DOUBLE)) AS result, CASE WHEN reported IS NOT NULL THEN 'reported' WHEN revenue - cost IS NOT NULL THEN 'computed' ELSE 'unknown' END AS source FROM r FULL JOIN c USING (org, year)""")
def statement_outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG16: two statements merged; a missing result is computed and says so."""
    l = ledger(spark, sf_dir)
    r = l.filter("code like '1%' and month > 6").groupBy("org", "year").agg(F.sum("plan").alias("revenue"))
    c = l.filter("code like '2%' and month <= 6").groupBy("org", "year").agg(F.sum("actual").alias("cost"), F.when(F.count(F.lit(1)) % 3 == 0, F.sum("plan")).alias("reported"))
    computed = F.col("revenue") - F.col("cost")
    source = F.when(F.col("reported").isNotNull(), "reported").when(computed.isNotNull(), "computed").otherwise("unknown")
    return r.join(c, ["org", "year"], "full_outer").select("org", "year", F.col("revenue").cast("double").alias("revenue"), F.col("cost").cast("double").alias("cost"), F.coalesce(F.col("reported").cast("double"), computed.cast("double")).alias("result"), source.alias("source"))


@query("""WITH e AS (SELECT p_brand AS code, p_type AS name, p_size AS valid_to, p_partkey AS k FROM part) SELECT code, arg_max(name, (valid_to, k)) AS name, MAX(valid_to)::BIGINT AS valid_to, COUNT(*) AS versions FROM e GROUP BY 1""")
def latest_code_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC22: the newest version of each code in a slowly changing list."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("code")).agg(F.max_by("p_type", F.struct("p_size", "p_partkey")).alias("name"), F.max("p_size").cast("long").alias("valid_to"), F.count(F.lit(1)).alias("versions"))


@query("""WITH m AS (SELECT DISTINCT year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders WHERE NOT (month(o_orderdate) = 12 AND year(o_orderdate) % 2 = 0)), r AS (SELECT *, MAX(m) OVER (PARTITION BY y) AS last FROM m) SELECT y AS year, m AS month, m = 12 AS final FROM r WHERE m = last""")
def final_or_latest_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC20: the December period of each year, else its latest interim one."""
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.month("o_orderdate").cast("long").alias("month")).filter("not (month = 12 and year % 2 = 0)")
    return o.groupBy("year").agg(F.max("month").alias("month")).withColumn("final", F.col("month") == 12)


@query("""WITH s AS (SELECT l_suppkey AS org, CAST(l_shipdate AS DATE) AS a, CASE WHEN l_linenumber = 7 AND l_quantity > 49 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS b FROM lineitem),
f AS (SELECT *, coalesce(b, DATE '9999-12-31') AS far FROM s), r AS (SELECT *, MAX(far) OVER (PARTITION BY org ORDER BY a, far ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY org ORDER BY a, far) AS n FROM f),
g AS (SELECT *, SUM(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY org ORDER BY n) AS island FROM r)
SELECT org, CAST(MIN(a) AS VARCHAR) AS start, CASE WHEN MAX(far) < DATE '9999-12-31' THEN CAST(MAX(far) AS VARCHAR) END AS stop, COUNT(*) AS parts FROM g GROUP BY org, island""")
def interval_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN07: intervals of office that touch or overlap become one; an open one absorbs the rest."""
    return _offices(table(spark, sf_dir, "lineitem"))


def _offices(li: DataFrame) -> DataFrame:
    start = F.to_date("l_shipdate")
    stop = F.when(~((F.col("l_linenumber") == 7) & (F.col("l_quantity") > 49)), F.date_add(start, F.col("l_quantity").cast("int")))
    s = li.select(F.col("l_suppkey").alias("org"), start.alias("start"), stop.alias("stop"))
    return islands(s, ["org"], "start", "stop").select("org", F.col("start").cast("string").alias("start"), F.col("stop").cast("string").alias("stop"), "parts")


@query("""WITH m AS (SELECT p_brand AS code, CAST(floor((p_retailprice * 10) % 60) AS BIGINT) AS period, COUNT(*) AS n FROM part GROUP BY 1, 2), s AS (SELECT code, MIN(period) AS a, MAX(period) AS b FROM m GROUP BY 1), x AS (SELECT code, unnest(range(a, b + 1)) AS period FROM s) SELECT code, period FROM x ANTI JOIN m USING (code, period)""")
def series_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN09: periods that a series lacks between its first and last."""
    m = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), F.floor((F.col("p_retailprice") * 10) % 60).alias("period")).distinct()
    axis = m.groupBy("code").agg(F.min("period").alias("a"), F.max("period").alias("b")).select("code", F.explode(F.sequence("a", "b")).alias("period"))
    return axis.join(m, ["code", "period"], "left_anti")


@query("""WITH s AS (SELECT o_orderpriority AS series, CAST(year(o_orderdate) AS BIGINT) AS year, CASE WHEN year(o_orderdate) = 1995 AND o_orderpriority LIKE '1%' THEN NULL ELSE SUM(CAST(o_totalprice AS DECIMAL(18,2))) END AS v FROM orders GROUP BY o_orderpriority, year(o_orderdate)),
n AS (SELECT COUNT(DISTINCT series) AS k FROM s), b AS (SELECT MIN(year) AS base FROM (SELECT year FROM s WHERE v > 0 GROUP BY year HAVING COUNT(*) = (SELECT k FROM n)))
SELECT s.series, s.year, base, CAST(s.v AS DOUBLE) / CAST(z.v AS DOUBLE) * 100 AS index_100 FROM s, b JOIN s z ON z.year = base WHERE z.series = s.series""")
def index_base_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG20: series as indices of their first common year with values; unknown stays unknown."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.year("o_orderdate").cast("long").alias("year")).agg(F.sum(exact(F.col("o_totalprice"))).alias("v"))
    s = o.withColumn("v", F.when(~((F.col("year") == 1995) & F.col("series").startswith("1")), F.col("v")))
    all_series = s.select(F.countDistinct("series").alias("k"))  # one row
    base = s.filter("v > 0").groupBy("year").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(all_series), F.col("n") == F.col("k")).agg(F.min("year").alias("base"))
    based = s.join(F.broadcast(base), F.col("year") == F.col("base")).select("series", "base", F.col("v").alias("z"))
    return s.join(based, "series").select("series", "year", "base", (ratio(F.col("v"), F.col("z")) * 100).alias("index_100"))


@query("""WITH l AS (SELECT l_orderkey AS k, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS parts, COUNT(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS id, CAST(parts AS DOUBLE) AS parts, o_totalprice AS stated, CASE WHEN parts IS NULL THEN 'unknown' WHEN abs(CAST(o_totalprice AS DECIMAL(18,2)) - parts) > 0.5 THEN 'differs' ELSE 'agrees' END AS verdict FROM orders LEFT JOIN l ON k = o_orderkey""")
def sum_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA06: stated totals against the sum of their parts, half a unit of tolerance; unknown parts give no verdict."""
    parts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sum(exact(F.col("l_extendedprice"))).alias("parts"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("stated"))
    verdict = F.when(F.col("parts").isNull(), "unknown").when(F.abs(exact(F.col("stated")) - F.col("parts")) > 0.5, "differs").otherwise("agrees")
    return o.join(parts, "id", "left").select("id", F.col("parts").cast("double").alias("parts"), "stated", verdict.alias("verdict"))


@query(f"""WITH {LEDGER}, a AS (SELECT year, substr(code, 1, 1) AS k, SUM(plan) AS v FROM ledger GROUP BY 1, 2), b AS (SELECT year, substr(code, 1, 1) AS k, CASE WHEN year % 3 = 0 THEN SUM(plan) + 1 WHEN year % 3 = 1 THEN SUM(plan) END AS v FROM ledger WHERE year <> 1998 GROUP BY year, substr(code, 1, 1))
SELECT year, k AS indicator, CAST(a.v AS DOUBLE) AS computed, CAST(b.v AS DOUBLE) AS published FROM a FULL JOIN b USING (year, k) WHERE (a.v IS NULL) <> (b.v IS NULL) OR abs(a.v - b.v) > 0.5""")
def recap_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN31: computed against published totals: value against unknown is a difference, unknown against unknown is none."""
    a = ledger(spark, sf_dir).groupBy("year", F.substring("code", 1, 1).alias("indicator")).agg(F.sum("plan").alias("c"))
    b = a.filter("year <> 1998").select("year", "indicator", F.when(F.col("year") % 3 == 0, F.col("c") + 1).when(F.col("year") % 3 == 1, F.col("c")).alias("p"))
    both = a.join(b, ["year", "indicator"], "full_outer").filter((F.col("c").isNull() != F.col("p").isNull()) | (F.abs(F.col("c") - F.col("p")) > 0.5))
    return both.select("year", "indicator", F.col("c").cast("double").alias("computed"), F.col("p").cast("double").alias("published"))


@query("""WITH s AS (SELECT CASE WHEN p_size < 10 THEN p_brand ELSE p_brand || '-' || p_type END AS dim, p_size AS period, p_retailprice AS v, p_partkey FROM part) SELECT dim, CAST(period AS BIGINT) AS period, arg_min(v, p_partkey) AS value, COUNT(*) AS found, COUNT(*) > 1 AS ambiguous FROM s GROUP BY 1, 2""")
def series_ambiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27: one value for each period of a series; several are reported, not summed."""
    p = table(spark, sf_dir, "part")
    dim = F.when(F.col("p_size") < 10, F.col("p_brand")).otherwise(F.concat_ws("-", "p_brand", "p_type"))
    n = F.count(F.lit(1))
    return p.groupBy(dim.alias("dim"), F.col("p_size").cast("long").alias("period")).agg(F.min_by("p_retailprice", "p_partkey").alias("value"), n.alias("found"), (n > 1).alias("ambiguous"))


@query("""WITH l AS (SELECT p_type AS layer, p_size AS year, COUNT(*) AS n FROM part WHERE p_size % 3 = 0 GROUP BY 1, 2), q AS (SELECT DISTINCT p_type AS layer, unnest([1, 7, 20, 33, 50]) AS wanted FROM part)
SELECT layer, CAST(wanted AS BIGINT) AS wanted, CAST(coalesce(MAX(year) FILTER (WHERE year <= wanted), MIN(year)) AS BIGINT) AS used, bool_or(year = wanted) AS exact FROM q JOIN l USING (layer) GROUP BY 1, 2""")
def latest_layer_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN27: the layer of the year asked for, else the nearest earlier, else the oldest."""
    p = table(spark, sf_dir, "part")
    layers = p.filter("p_size % 3 = 0").select(F.col("p_type").alias("layer"), F.col("p_size").cast("long").alias("year")).distinct()
    wanted = p.select(F.col("p_type").alias("layer")).distinct().withColumn("wanted", F.explode(F.array(*[F.lit(x).cast("long") for x in (1, 7, 20, 33, 50)])))
    used = F.coalesce(F.max(F.when(F.col("year") <= F.col("wanted"), F.col("year"))), F.min("year"))
    return wanted.join(layers, "layer").groupBy("layer", "wanted").agg(used.alias("used"), F.bool_or(F.col("year") == F.col("wanted")).alias("exact"))


@query("""SELECT n_regionkey AS area, c_mktsegment AS kind, COUNT(*) AS companies, COUNT(*) FILTER (WHERE c_acctbal < 0) AS excluded, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) FILTER (WHERE c_acctbal >= 0) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)""")
def company_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN02, AG33, AG34: counts over a hierarchy and a category, all combinations; excluded forms counted apart."""
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are a code list
    return c.cube(F.col("n_regionkey").alias("area"), F.col("c_mktsegment").alias("kind")).agg(F.count(F.lit(1)).alias("companies"), F.count_if(F.col("c_acctbal") < 0).alias("excluded"), F.sum(F.when(F.col("c_acctbal") >= 0, exact(F.col("c_acctbal")))).cast("double").alias("balance"))


@query("""WITH f AS (SELECT s_suppkey AS firm, s_nationkey % 10 + (s_suppkey % 9) * 10 AS division FROM supplier), s AS (SELECT * FROM (VALUES ('A', 1, 3), ('B', 5, 9), ('C', 10, 33), ('F', 41, 43), ('G', 45, 47), ('M', 69, 82)) t(section, lo, hi)) SELECT coalesce(section, '?') AS section, COUNT(*) AS firms, string_agg(CAST(firm AS VARCHAR), ',' ORDER BY firm) AS list FROM f LEFT JOIN s ON division BETWEEN lo AND hi GROUP BY 1""")
def field_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22: codes mapped to sections by ranges; a code outside all ranges is kept as unknown."""
    f = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("firm"), (F.col("s_nationkey") % 10 + (F.col("s_suppkey") % 9) * 10).alias("division"))
    ranges = (("A", 1, 3), ("B", 5, 9), ("C", 10, 33), ("F", 41, 43), ("G", 45, 47), ("M", 69, 82))
    section = F.coalesce(*[F.when(F.col("division").between(lo, hi), s) for s, lo, hi in ranges], F.lit("?"))  # six ranges need no join
    return f.groupBy(section.alias("section")).agg(F.count(F.lit(1)).alias("firms"), F.array_join(F.array_sort(F.collect_list("firm")).cast("array<string>"), ",").alias("list"))


@query("""WITH s AS (SELECT l_suppkey AS org, MIN(CAST(l_shipdate AS DATE)) AS a, CASE WHEN l_suppkey % 3 > 0 THEN MAX(CAST(l_shipdate AS DATE)) END AS b FROM lineitem GROUP BY l_suppkey), x AS (SELECT year(a) AS year, 1 AS came, 0 AS went FROM s UNION ALL SELECT year(b), 0, 1 FROM s WHERE b IS NOT NULL) SELECT CAST(year AS BIGINT) AS year, CAST(SUM(came) AS BIGINT) AS came, CAST(SUM(went) AS BIGINT) AS went FROM x GROUP BY 1""")
def arrivals_departures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG21: starts and ends of engagements by year; open ones have no end."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("org")).agg(F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b")).withColumn("b", F.when(F.col("org") % 3 > 0, F.col("b")))
    ends = s.select(F.explode(F.array(F.struct(F.col("a").alias("year"), F.lit(1).alias("came"), F.lit(0).alias("went")), F.struct(F.col("b").alias("year"), F.lit(0).alias("came"), F.lit(1).alias("went")))).alias("x")).select("x.*").filter("year is not null")
    return ends.groupBy(F.col("year").cast("long").alias("year")).agg(F.sum("came").alias("came"), F.sum("went").alias("went"))


@query("""WITH l AS (SELECT l_orderkey AS meeting, l_linenumber AS point, arg_min(l_extendedprice, (l_partkey, l_extendedprice)) AS amount FROM lineitem GROUP BY 1, 2), n AS (SELECT meeting, COUNT(*) AS points FROM l GROUP BY 1) SELECT l.meeting, point, points, amount, o_orderpriority AS heading, o_totalprice AS stated FROM l JOIN n USING (meeting) LEFT JOIN orders ON o_orderkey = l.meeting""")
def nested_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PJ01, AR06: meetings with nested points, flattened; a point inherits from its meeting."""
    li = first_by(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_extendedprice"))
    meetings = li.groupBy(F.col("l_orderkey").alias("meeting")).agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("point"), F.col("l_extendedprice").alias("amount")))).alias("body"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("meeting"), F.col("o_orderpriority").alias("heading"), F.col("o_totalprice").alias("stated"))
    return meetings.join(o, "meeting", "left").select("meeting", F.size("body").cast("long").alias("points"), "heading", "stated", F.explode("body").alias("b")).select("meeting", "b.point", "points", "b.amount", "heading", "stated")
