"""Operators on keyed rows: first of a key, top of a group, dense axes, majorities, islands, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civicrill.sources.shared import written


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One whole row of each key, the first in ``order`` (make it unique). An aggregate, so hot keys fold before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")).select(*keys, "__row.*") if rest else df.distinct()


def top_k(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key in ``order`` (make it unique), with their rank. Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def places(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """``df`` with the place (long, from 1) of each row within its key in ``order`` (make it unique), for keys of any size.

    Rows are sorted over all tasks by ranges of key and order and written once; a row's place is its place in the range plus
    the key's rows in the ranges before. What is joined back is one row for each key and range that holds it.
    """
    part = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id())
    part = written(part.withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "places")
    held = part.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__from"))
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part")) - F.col("__n")
    shift = held.select("__part", *[F.col(k).alias(f"__{k}") for k in keys], (before - F.col("__from") + 1).alias("__shift"))
    on = [part["__part"] == shift["__part"], *[part[k].eqNullSafe(shift[f"__{k}"]) for k in keys]]
    return part.join(shift, on).select(*[part[c] for c in df.columns], (F.col("__at") + F.col("__shift")).alias("place"))


def dense(df: DataFrame, key: str, at: str, first: Column, last: Column) -> DataFrame:
    """(key, at) for each whole number from first to last of each key."""
    spans = df.groupBy(key).agg(first.alias("__a"), last.alias("__b")).filter("__a is not null")
    return spans.select(key, F.explode(F.sequence("__a", "__b")).alias(at))


def majority(counts: DataFrame, key: str, value: str, n: str) -> DataFrame:
    """(key, majority): the most frequent value, null when the first place is shared."""
    best = counts.groupBy(key).agg(F.max(n).alias("__n"))
    return counts.join(best, key).filter(F.col(n) == F.col("__n")).groupBy(key).agg(F.when(F.count(F.lit(1)) == 1, F.min(value)).alias("majority"))


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals that touch or overlap, merged; an open end (null) absorbs what follows. Returns keys, start, end, parts."""
    w = Window.partitionBy(*keys).orderBy(start, F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")))
    far = F.coalesce(F.col(end), F.lit("9999-12-31").cast("date"))
    marked = df.withColumn("__far", far).withColumn("__reach", F.max("__far").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = marked.withColumn("__island", F.sum(F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max("__far").alias("__far"), F.count(F.lit(1)).alias("parts"))
    return merged.select(*keys, start, F.when(F.col("__far") < F.lit("9999-12-31").cast("date"), F.col("__far")).alias(end), "parts")


def differences(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """key, change (added, removed, changed, same) and the names of unequal fields, null equal to null."""
    a = old.select(key, F.struct(*fields).alias("__old"))
    b = new.select(key, F.struct(*fields).alias("__new"))
    unequal = F.array_compact(F.array(*[F.when(~F.col(f"__old.{f}").eqNullSafe(F.col(f"__new.{f}")), F.lit(f)) for f in fields]))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.size(unequal) > 0, "changed").otherwise("same")
    return a.join(b, key, "full_outer").select(key, change.alias("change"), F.when(change == "changed", F.array_join(unequal, ",")).otherwise("").alias("fields"))
