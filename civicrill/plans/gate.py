"""Publication gate: checks that give one verdict row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.plans.registry import query
from civicrill.plans.standins import BALLOTS, CONTRACTS, ballots, contracts
from civicrill.sources.tables import table


def verdict(df: DataFrame, check: str, bad: Column, level: str = "error") -> DataFrame:
    """check, checked, failures, state: ok, ``level`` or empty (nothing to check is not a pass)."""
    n, k = F.count(F.lit(1)), F.count_if(bad)
    return df.agg(F.lit(check).alias("check"), n.alias("checked"), k.alias("failures"), F.when(n == 0, "empty").when(k > 0, level).otherwise("ok").alias("state"))


@query("""SELECT o_custkey AS key, COUNT(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > -500) GROUP BY 1""")
def referential_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ04, PG23: keys without a counterpart, with how many rows they carry."""
    known = table(spark, sf_dir, "customer").filter("c_acctbal > -500").select(F.col("c_custkey").alias("key"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).join(known, "key", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("rows"))


@query("""WITH used AS (SELECT DISTINCT p_type AS code FROM part), list AS (SELECT * FROM (VALUES ('ECONOMY'), ('SMALL'), ('LARGE'), ('UNUSED')) v(code)) SELECT coalesce(u.code, l.code) AS code, CASE WHEN l.code IS NULL THEN 'not in the list' ELSE 'not used' END AS problem FROM used u FULL JOIN list l ON u.code = l.code WHERE u.code IS NULL OR l.code IS NULL""")
def code_list_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ05: codes in use and codes in the list must be the same set."""
    used = table(spark, sf_dir, "part").select(F.col("p_type").alias("code")).distinct().withColumn("u", F.lit(1))
    listed = spark.createDataFrame([("ECONOMY",), ("SMALL",), ("LARGE",), ("UNUSED",)], "code string").withColumn("l", F.lit(1))
    return used.join(listed, "code", "full_outer").filter("u is null or l is null").select("code", F.when(F.col("l").isNull(), "not in the list").otherwise("not used").alias("problem"))


@query("""SELECT p_brand AS series, COUNT(*) AS points, COUNT(DISTINCT v) = 1 AND COUNT(*) >= 3 AS constant FROM (SELECT p_brand, CASE WHEN p_brand LIKE '%7' THEN 1 ELSE p_size END AS v FROM part) GROUP BY 1""")
def constant_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ08: a series of three values or more that never changes is suspect."""
    v = F.when(F.col("p_brand").endswith("7"), 1).otherwise(F.col("p_size"))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("series"), v.alias("v")).groupBy("series").agg(F.count(F.lit(1)).alias("points"), ((F.countDistinct("v") == 1) & (F.count(F.lit(1)) >= 3)).alias("constant"))


@query(f"""WITH {CONTRACTS} SELECT CASE WHEN amount > 450000 THEN 'error' WHEN amount > 400000 THEN 'warning' WHEN amount IS NULL THEN 'unknown' ELSE 'ok' END AS state, COUNT(*) AS contracts FROM contracts GROUP BY 1""")
def amount_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ01, FL12: amounts above a ceiling; an unknown amount is no error and no pass."""
    state = F.when(F.col("amount") > 450000, "error").when(F.col("amount") > 400000, "warning").when(F.col("amount").isNull(), "unknown").otherwise("ok")
    return contracts(spark, sf_dir).groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("contracts"))


@query(f"""WITH {CONTRACTS}, {BALLOTS}, c AS (
 SELECT 'amounts' AS "check", COUNT(*) AS checked, COUNT(*) FILTER (WHERE amount > 450000) AS failures, 'error' AS level FROM contracts
 UNION ALL SELECT 'false zeros', COUNT(*), COUNT(*) FILTER (WHERE amount = 0), 'error' FROM contracts
 UNION ALL SELECT 'dates', COUNT(*), COUNT(*) FILTER (WHERE day IS NULL), 'warning' FROM contracts
 UNION ALL SELECT 'coordinates', COUNT(*), COUNT(*) FILTER (WHERE NOT (n_nationkey BETWEEN 0 AND 24)), 'error' FROM nation
 UNION ALL SELECT 'pages', COUNT(*), COUNT(*) FILTER (WHERE len(regexp_extract_all(html, '<[a-zA-Z]')) > 60), 'warning' FROM pages
 UNION ALL SELECT 'profiles', COUNT(*), COUNT(*) FILTER (WHERE a <> b), 'error' FROM (SELECT person, COUNT(*) AS a, COUNT(*) FILTER (WHERE cast_vote) + COUNT(*) FILTER (WHERE NOT cast_vote) AS b FROM ballots GROUP BY 1))
SELECT "check", checked, failures, CASE WHEN checked = 0 THEN 'empty' WHEN failures > 0 THEN level ELSE 'ok' END AS state FROM c""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ01-DQ03, DQ07, DQ10, DQ12, DQ13: every check on its own, one row each."""
    c = contracts(spark, sf_dir)
    profiles = ballots(spark, sf_dir).groupBy("person").agg(F.count(F.lit(1)).alias("a"), (F.count_if("cast_vote") + F.count_if(~F.col("cast_vote"))).alias("b"))
    checks = [
        verdict(c, "amounts", F.col("amount") > 450000),
        verdict(c, "false zeros", F.col("amount") == 0),
        verdict(c, "dates", F.col("day").isNull(), "warning"),
        verdict(table(spark, sf_dir, "nation"), "coordinates", ~F.col("n_nationkey").between(0, 24)),
        verdict(table(spark, sf_dir, "pages"), "pages", F.regexp_count("html", F.lit("<[a-zA-Z]")) > 60, "warning"),
        verdict(profiles, "profiles", F.col("a") != F.col("b")),
    ]
    out = checks[0]
    for x in checks[1:]:
        out = out.unionByName(x)
    return out


@query("""SELECT 'customer' AS name, 'c_acctbal' AS field, COUNT(*) AS rows, COUNT(*) FILTER (WHERE c_acctbal > 0) AS filled, COUNT(*) FILTER (WHERE c_acctbal > 0) > 0 AS ever FROM customer UNION ALL SELECT 'events', 'props', COUNT(*), COUNT(*) FILTER (WHERE props IS NOT NULL), COUNT(*) FILTER (WHERE props IS NOT NULL) > 0 FROM events""")
def filled_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PG15: whether a field is ever filled, and how often."""
    one = lambda t, f, good: table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.lit(f).alias("field"), F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("filled"), (F.count_if(good) > 0).alias("ever"))
    return one("customer", "c_acctbal", F.col("c_acctbal") > 0).unionByName(one("events", "props", F.col("props").isNotNull()))
