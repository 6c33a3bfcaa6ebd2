"""Names found in sentences by the beginnings of all their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.functions.text import word_list

#: Letters of a word that its cases share.
SHARED = 5


def beginnings(text: Column, shortest: int = 1) -> Column:
    """The first letters of the distinct words of at least ``shortest`` letters."""
    words = F.filter(word_list(text), lambda w: F.length(w) >= shortest)
    return F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, SHARED)))


def longest_named(sentences: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str) -> DataFrame:
    """``id_col`` and the longest name all of whose beginnings its sentence has; null without one, the greater name of equally long ones.

    A name needs two different beginnings. Each name waits at its rarest beginning only, so words that most names share bring no
    sentence and name together; what meets there is checked in whole. Repeated names count once, repeated sentences stay.
    """
    n = names.filter(F.col(name_col).isNotNull()).select(F.col(name_col).alias("_name")).distinct().withColumn("_need", beginnings(F.col("_name"), 2)).filter(F.size("_need") >= 2)
    each = n.select("_name", "_need", F.explode("_need").alias("_word"))
    rare = each.join(each.groupBy("_word").agg(F.count(F.lit(1)).alias("_df")), "_word")
    waiting = rare.groupBy("_name", "_need").agg(F.min_by("_word", F.struct("_df", "_word")).alias("_word"))
    asked = sentences.select(F.col(id_col).alias("_id"), beginnings(F.col(text_col)).alias("_have")).distinct()
    met = asked.select("_id", "_have", F.explode("_have").alias("_word")).join(waiting, "_word").filter(F.size(F.array_except("_need", "_have")) == 0)
    best = met.groupBy("_id", "_have").agg(F.max_by("_name", F.struct(F.length("_name"), "_name")).alias(name_col))
    rows = sentences.select(F.col(id_col).alias(id_col), beginnings(F.col(text_col)).alias("_mine"))
    return rows.join(best, rows[id_col].eqNullSafe(best["_id"]) & rows["_mine"].eqNullSafe(best["_have"]), "left").select(id_col, name_col)
