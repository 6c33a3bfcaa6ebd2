"""Searches under a cap on results: cells are split by one dimension after another until each is small enough."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicrill.sources.shared import written


def split_under_cap(rows: DataFrame, dimensions: Sequence[str], cap: int) -> DataFrame:
    """(level, cell, n, state): the cells that together hold every row once, each of ``cap`` rows or fewer where that can be.

    The whole is the cell of level 0. A cell above the cap is split by the next dimension, the others are fetched as they
    are; a cell is named by its values, joined by a slash (``?`` for null). state is ``fetched``, or ``over`` for a cell that
    no dimension is left to split. Rows fold to counts of all dimensions once; the frontier works on the counts, and the
    sum of n over the cells is the number of rows, which proves them complete.
    """
    counts = written(rows.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n")), "frontier")
    cells = None
    name = F.lit("")
    frontier = counts.withColumn("cell", name)
    for level in range(len(dimensions) + 1):
        totals = frontier.groupBy("cell").agg(F.sum("n").alias("total"))
        last = level == len(dimensions)
        settled = totals if last else totals.filter(F.col("total") <= cap)
        state = F.when(F.col("total") <= cap, "fetched").otherwise("over")
        out = settled.select(F.lit(level).alias("level"), "cell", F.col("total").alias("n"), state.alias("state"))
        cells = out if cells is None else cells.unionByName(out)
        if not last:
            over = frontier.join(totals.filter(F.col("total") > cap).select("cell"), "cell", "left_semi")
            value = F.coalesce(F.col(dimensions[level]).cast("string"), F.lit("?"))
            frontier = over.withColumn("cell", F.concat_ws("/", F.when(F.lit(level > 0), F.col("cell")), value))
    return cells
