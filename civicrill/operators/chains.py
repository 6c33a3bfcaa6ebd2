"""Chains of rows that each point to one before them, followed to their beginnings by doubled steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicrill.sources.shared import written

#: Rounds at most; chains of up to 2 ** ROUNDS rows.
ROUNDS = 40


def beginnings(links: DataFrame, key: str, before: str, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """((key, root, hops), rounds): where the chain of each row begins, and how many links lie between.

    ``links`` has unique keys; ``before`` is null where a chain begins, and so is one that names no row of the table or its own. Each
    round replaces a row's pointer by its pointer's pointer, so steps double: a chain of n links takes log2(n) + 1
    rounds. Rows that have met their beginning take no further step. The side that is looked up has one row a key; many
    rows that point to one beginning are dealt by Spark's handling of skew. Raises ValueError when pointers run in a circle.
    """
    known = links.select(F.col(key).alias("__b")).filter("__b is not null")
    rows = links.filter(f"{key} is not null").join(known, (F.col(before) == F.col("__b")) & (F.col(before) != F.col(key)), "left")
    state = written(rows.select(key, F.coalesce("__b", key).alias("root"), F.col("__b").isNotNull().cast("int").alias("hops"), F.col("__b").isNotNull().alias("open")), "chains")
    first, met, going, took = state.filter("not open"), None, state.filter("open"), 0
    while not going.isEmpty():
        if took >= rounds:
            raise ValueError(f"a chain goes on after {rounds} rounds")
        took += 1
        # a pointer that is no row of these is a beginning; one that has met its own beginning tells it
        step = going if met is None else going.unionByName(met)
        via = step.select(F.col(key).alias("root"), F.col("root").alias("__on"), F.col("hops").alias("__more"), F.col("open").alias("__open"))
        jumped = going.drop("open").join(via, "root", "left")
        jumped = jumped.select(key, F.coalesce("__on", "root").alias("root"), (F.col("hops") + F.coalesce("__more", F.lit(0))).alias("hops"), F.coalesce("__open", F.lit(False)).alias("open"))
        state = written(jumped, "chains")
        new, going = state.filter("not open"), state.filter("open")
        met = new if met is None else met.unionByName(new)
    out = first if met is None else first.unionByName(met)
    return out.select(key, "root", "hops"), took
