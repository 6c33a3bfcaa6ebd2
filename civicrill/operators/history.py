"""Histories with validity out of successive snapshots, in one ordered pass over each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _union_so_far(name: str, order) -> Column:
    """Values of an array column up to the row, each once, in the order in which they were first seen."""
    return F.array_distinct(F.flatten(F.collect_list(name).over(order.rowsBetween(Window.unboundedPreceding, 0))))


def versions(snapshots: DataFrame, key: str, at: str, tracked: Sequence[str], lists: Sequence[str] = (), manual: Sequence[str] = ()) -> DataFrame:
    """key, ``tracked``, ``lists``, ``manual``, valid_from and valid_to: a row for each time in which a key's tracked fields did not change.

    ``snapshots`` has one row per key and ``at``, the times of all snapshots together. A version ends (valid_to) at the first
    snapshot that shows other values or lacks the key, and is null while it lasts; null equals null. A list holds every
    value seen up to the version's end, in the order of first sight. A manual field keeps the first value that it ever had. Rows
    without key or time are left out. Repeated rows of a key and time count once, the smallest by their values.
    """
    known = snapshots.filter(f"{key} is not null and {at} is not null").select(key, at, *tracked, *lists, *manual)
    known = known.groupBy(key, at).agg(F.min(F.struct(*tracked, *lists, *manual)).alias("__row")).select(key, at, "__row.*")
    # a row for each time of any snapshot: one a day or week, bounded by the calendar
    times = known.select(at).distinct().withColumn("__next", F.lead(at).over(Window.orderBy(at)))
    rows = known.join(times, at)
    order = Window.partitionBy(key).orderBy(at)
    same = F.lit(True)
    for c in tracked:
        same &= F.col(c).eqNullSafe(F.lag(c).over(order))
    follows = F.lag("__next").over(order) == F.col(at)
    rows = rows.withColumn("__new", (~(F.coalesce(follows, F.lit(False)) & same)).cast("int"))
    rows = rows.withColumns({c: _union_so_far(c, order) for c in lists} | {c: F.first(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for c in manual})
    rows = rows.withColumn("__version", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = [F.max_by(c, at).alias(c) for c in (*lists, *manual)]
    folded = rows.groupBy(key, "__version").agg(*[F.min_by(c, at).alias(c) for c in tracked], *last, F.min(at).alias("valid_from"), F.max_by("__next", at).alias("valid_to"))
    return folded.drop("__version")


def merged(history: DataFrame, snapshot: DataFrame, key: str, at: Column, tracked: Sequence[str], lists: Sequence[str] = (), manual: Sequence[str] = ()) -> DataFrame:
    """``history`` (as versions() gives it) with the snapshot of a later time ``at``; the same snapshot again changes nothing.

    Every key has one open version at most, which the snapshot continues, ends or follows by a new one. Lists and manual
    fields carry on from the key's last version. One join on the key.
    """
    fields, columns = [*tracked, *lists, *manual], [key, *tracked, *lists, *manual, "valid_from", "valid_to"]
    seen = snapshot.filter(f"{key} is not null").groupBy(key).agg(F.min(F.struct(*fields)).alias("__now"))
    last = history.groupBy(key).agg(F.max_by(F.struct(*columns[1:]), "valid_from").alias("__last"))
    both = last.join(seen, key, "full_outer")
    open_ = F.col("__last").isNotNull() & F.col("__last.valid_to").isNull()
    same = F.lit(True)
    for c in tracked:
        same &= F.col(f"__last.{c}").eqNullSafe(F.col(f"__now.{c}"))
    going_on = open_ & F.col("__now").isNotNull() & same
    carried = {c: F.array_distinct(F.concat(F.coalesce(F.col(f"__last.{c}"), F.array()), F.coalesce(F.col(f"__now.{c}"), F.array()))) for c in lists}
    carried |= {c: F.coalesce(F.col(f"__last.{c}"), F.col(f"__now.{c}")) for c in manual}
    kept = lambda c: F.when(going_on, carried[c]).otherwise(F.col(f"__last.{c}")) if c in carried else F.col(f"__last.{c}")
    stay = F.struct(*[kept(c).alias(c) for c in fields], F.col("__last.valid_from").alias("valid_from"), F.when(open_ & ~going_on, at).otherwise(F.col("__last.valid_to")).alias("valid_to"))
    new = F.struct(*[carried.get(c, F.col(f"__now.{c}")).alias(c) for c in fields], at.alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    rows = F.array_compact(F.array(F.when(F.col("__last").isNotNull(), stay), F.when(F.col("__now").isNotNull() & ~going_on, new)))
    latest = both.select(key, F.explode(rows).alias("r")).select(key, "r.*").select(*columns)
    older = history.join(last.select(key, F.col("__last.valid_from").alias("valid_from")), [key, "valid_from"], "left_anti").select(*columns)
    return older.unionByName(latest)
