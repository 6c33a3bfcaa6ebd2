"""Similarity of token sets: document frequencies, weighted overlap and rare-term candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicrill.operators.keyed import top_k
from civicrill.sources.shared import written

#: Of sums of weights, against rounding; only filters of candidates have it.
SLACK = 1e-6


def tokens_of(df: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, token), distinct."""
    return df.select(key, F.explode(F.array_distinct(words)).alias("token"))


def frequencies(tokens: DataFrame, key: str) -> DataFrame:
    """(token, df): how many keys carry a token."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def weighted_jaccard(a: DataFrame, b: DataFrame, a_key: str, b_key: str, df: DataFrame, least: float, weight: Column) -> DataFrame:
    """(a_key, b_key, shared, overlap, similarity, rarest) of all pairs whose similarity is ``least`` or more, which is above 0; rarest is the least df of a shared token.

    ``weight`` is a positive expression over df. The tokens of a row that the other side has are ordered by frequency, rarest
    first, and each knows what they weigh from there on (rest). At its first shared token a pair has no more overlap
    than either rest, so rests must reach ``least`` of their own row's weight (prefix filter on both sides) and what the
    overlap of two such weights needs (length and positional filters). No pair at the threshold is lost, however frequent its tokens.
    What remains is verified by joins on ids and tokens; no row carries the tokens of another.
    """
    weighed = df.withColumn("w", weight.cast("double"))
    both = a.select("token").distinct().join(b.select("token").distinct(), "token")
    shared = written(weighed.join(both, "token"), "weights")
    needed = (F.col("wa") + F.col("wb")) * (least / (1 + least)) - SLACK

    def side(t: DataFrame, k: str, total: str, rest: str) -> tuple[DataFrame, DataFrame]:
        """(k, token, w, total) of shared tokens, and those of them in the prefix with their rest; rows that cannot reach ``least`` are left out."""
        totals = t.join(weighed.select("token", "w"), "token").groupBy(k).agg(F.sum("w").alias(total))
        own = t.join(shared, "token")
        most = own.groupBy(k).agg(F.sum("w").alias("__most")).join(totals, k).filter(F.col("__most") >= F.col(total) * least - SLACK).select(k, total)
        own = written(own.join(most, k).select(k, "token", "df", "w", total), "side")
        onward = Window.partitionBy(k).orderBy("df", "token").rowsBetween(0, Window.unboundedFollowing)
        prefix = own.withColumn(rest, F.sum("w").over(onward)).filter(F.col(rest) >= F.col(total) * least - SLACK)
        return own.select(k, "token", "df", "w", total), prefix.select(k, "token", total, rest)

    (own_a, prefix_a), (own_b, prefix_b) = side(a, a_key, "wa", "__ra"), side(b, b_key, "wb", "__rb")
    met = prefix_a.join(prefix_b, "token").filter(F.least("__ra", "__rb") >= needed)
    pairs = met.select(a_key, b_key).distinct()
    again = pairs.join(own_a, a_key).join(own_b.select(b_key, "token", "wb"), [b_key, "token"])
    sums = again.groupBy(a_key, b_key).agg(F.count(F.lit(1)).alias("shared"), F.sum("w").alias("overlap"), F.first("wa").alias("wa"), F.first("wb").alias("wb"), F.min("df").alias("rarest"))
    union = F.col("wa") + F.col("wb") - F.col("overlap")
    out = sums.select(a_key, b_key, "shared", "overlap", F.try_divide(F.col("overlap"), union).alias("similarity"), "rarest")
    return out.filter(F.col("similarity") >= least)


def rare_matches(a: DataFrame, b: DataFrame, a_key: str, b_key: str, df: DataFrame, cap: int, points: Column, least: int, k: int, rivals: int) -> DataFrame:
    """Top ``k`` of each a_key by points of shared rare tokens; keys with more than ``rivals`` candidates are dropped as ambiguous."""
    rare = df.filter(F.col("df") <= cap).select("token", points.alias("points"))
    scored = a.join(rare, "token").join(b, "token").groupBy(a_key, b_key).agg(F.sum("points").alias("score"), F.count(F.lit(1)).alias("shared")).filter(F.col("score") >= least)
    count = scored.groupBy(a_key).agg(F.count(F.lit(1)).alias("rivals")).filter(F.col("rivals") <= rivals)
    return top_k(scored.join(count, a_key), [a_key], k, F.col("score").desc(), F.col("shared").desc(), F.col(b_key))
