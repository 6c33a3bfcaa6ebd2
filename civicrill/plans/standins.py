"""Views of the test tables that stand in for civic records, each with the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicrill.functions.dates import reasonable
from civicrill.functions.numbers import exact
from civicrill.sources.tables import table

#: Prices below this are undisclosed (null) in the stand-in; days of earlier years are not to be trusted.
DISCLOSED, FIRST_YEAR, LAST_YEAR = 20_000, 1996, 2001
AS_OF = "2001-06-30"


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, owner, party, party_name, signed, day (null when out of range), amount (null when undisclosed), direction."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    signed = F.to_date("o_orderdate")
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("c_nationkey").alias("owner"),
        F.col("o_custkey").alias("party"),
        F.col("c_name").alias("party_name"),
        signed.alias("signed"),
        reasonable(signed, FIRST_YEAR, LAST_YEAR).alias("day"),
        F.when(F.col("o_totalprice") >= DISCLOSED, exact(F.col("o_totalprice"))).alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "expense").when(F.col("o_orderstatus") == "O", "income").otherwise("undetermined").alias("direction"),
    )


CONTRACTS = f"""contracts AS (
  SELECT o_orderkey AS id, c_nationkey AS owner, o_custkey AS party, c_name AS party_name, CAST(o_orderdate AS DATE) AS signed,
    CASE WHEN year(o_orderdate) BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN CAST(o_orderdate AS DATE) END AS day,
    CASE WHEN o_totalprice >= {DISCLOSED} THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS amount,
    CASE o_orderstatus WHEN 'F' THEN 'expense' WHEN 'O' THEN 'income' ELSE 'undetermined' END AS direction
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

CAST_VOTES = ("view", "click", "purchase")


def ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vote (hour), person, party, state; one ballot of each person in a vote, that of the smallest event."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").alias("vote"), F.col("user_id").alias("person"), F.col("event_id"), F.col("event_type"))
    one = e.groupBy("vote", "person").agg(F.min_by("event_type", "event_id").alias("state"))
    return one.select("vote", "person", (F.col("person") % 3).alias("party"), "state", F.col("state").isin(*CAST_VOTES).alias("cast_vote"))


BALLOTS = """ballots AS (
  SELECT date_trunc('hour', ts) AS vote, user_id AS person, user_id % 3 AS party, arg_min(event_type, event_id) AS state,
    arg_min(event_type, event_id) IN ('view', 'click', 'purchase') AS cast_vote
  FROM events GROUP BY 1, 2, 3)"""
