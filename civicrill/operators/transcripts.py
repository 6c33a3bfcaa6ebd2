"""Ordered segments: headings carried on, blocks of one speaker, repeats suppressed.

What depends on a running buffer with resets cannot be a plain window: it folds each recording's ordered
segments in one aggregate expression. A recording is one key's rows; its segments fit in a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, keys: Sequence[str], position: str, value: str, out: str) -> DataFrame:
    """``out`` is the last known ``value`` up to each position."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def _folded(df: DataFrame, key: str, position: str, *fields: str) -> DataFrame:
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(position, *fields))).alias("__rows"))


def blocks(df: DataFrame, key: str, position: str, speaker: str, size: str, least: int) -> DataFrame:
    """(key, block, speaker, segments, size): segments append while the speaker stays and the block is below ``least``."""
    kind = "array<struct<speaker:string,segments:bigint,size:bigint>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.struct(x[speaker].alias("speaker"), F.lit(1).cast("long").alias("segments"), x[size].alias("size"))
        grown = F.struct(last["speaker"].alias("speaker"), (last["segments"] + 1).alias("segments"), (last["size"] + x[size]).alias("size"))
        fits = (F.size(done) > 0) & last["speaker"].eqNullSafe(x[speaker]) & (last["size"] < least)
        return F.when(F.size(done) == 0, F.array(new)).when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    # an empty list has no last element to look at, so the first segment starts the fold
    first = F.transform(F.slice("__rows", 1, 1), lambda x: F.struct(x[speaker].alias("speaker"), F.lit(1).cast("long").alias("segments"), x[size].alias("size"))).cast(kind)
    rest = F.slice("__rows", F.lit(2), F.greatest(F.size("__rows") - 1, F.lit(0)))
    return _folded(df, key, position, speaker, size).select(key, F.posexplode(F.aggregate(rest, first, step)).alias("p", "b")).select(key, (F.col("p") + 1).cast("long").alias("block"), "b.speaker", "b.segments", "b.size")


def without_repeats(df: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """Rows whose text is not the end of the last kept row's text."""

    def step(s: Column, x: Column) -> Column:
        repeat = s["last"].endswith(x[text])
        return F.struct(F.when(repeat, s["last"]).otherwise(x[text]).alias("last"), F.when(repeat, s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"))

    rows = _folded(df, key, position, text)
    kind = rows.schema["__rows"].dataType.simpleString()
    # a mark that no text ends with, so that the first row is kept
    start = F.struct(F.lit("").alias("last"), F.array().cast(kind).alias("out"))
    return rows.select(key, F.explode(F.aggregate("__rows", start, step, lambda s: s["out"])).alias("r")).select(key, "r.*")
