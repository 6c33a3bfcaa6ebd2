"""Order of names by the rules of a language, in sorts, groups and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicrill.operators.keyed import places

#: Czech rules: ch after h, letters with hooks after their plain ones, accents and case only where all else is equal.
CZECH, CZECH_PLAIN = "cs", "cs_CI_AI"


def by_rules(name: Column, rules: str = CZECH) -> Column:
    """``name`` with the rules of its language for all comparisons."""
    return F.collate(name, rules)


def listed(rows: DataFrame, name: str, *rest: str, partitions: int = 8) -> DataFrame:
    """``rows`` in the order of Czech names, then of ``rest``: ranges go to partitions, each is sorted by itself. Nulls come first."""
    order = [by_rules(F.col(name)), *[F.col(c) for c in rest]]
    return rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def initials(rows: DataFrame, name: str) -> DataFrame:
    """(initial, names): rows under each heading of a Czech index; ch is one letter, hooked letters stand apart, accented ones do not."""
    text = F.trim(F.col(name))
    first = F.when(F.lower(F.left(text, F.lit(2))) == "ch", "CH").otherwise(F.upper(F.left(text, F.lit(1))))
    plain = F.translate(first, "ÁÉĚÍÓÚŮÝĎŤŇ", "AEEIOUUYDTN")
    return rows.filter(text != "").groupBy(plain.alias("initial")).agg(F.count(F.lit(1)).alias("names"))


def placed(rows: DataFrame, name: str, *rest: str) -> DataFrame:
    """``rows`` with their place from 1 in Czech order of ``name``, then by ``rest``; no task holds all of them."""
    whole = rows.withColumn("__all", F.lit(1))
    return places(whole, ["__all"], by_rules(F.col(name)), *[F.col(c) for c in rest]).drop("__all")
