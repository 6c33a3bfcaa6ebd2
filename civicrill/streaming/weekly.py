"""Streaming forms of the weekly window, of first sightings and of page changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(EVENT).option("pathGlobFilter", pattern).parquet(folder)


def weekly(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts in windows of eight days that begin every seven; events later than ``late`` are left out."""
    w = F.window("ts", "8 days", "7 days")
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value")).select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "event_type", "items", F.col("value").cast("double").alias("value"))


def first_sightings(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event once, though sources deliver it again within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def changes(stream: DataFrame) -> DataFrame:
    """(user_id, ts, before, after) whenever a user's event type differs from the one before; state is one value a key."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for pdf in batches:
            for r in pdf.sort_values(["ts", "event_id"]).itertuples():
                if last is not None and r.event_type != last:
                    out.append((key[0], r.ts, last, r.event_type))
                last = r.event_type
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "ts", "before", "after"])

    return stream.groupBy("user_id").applyInPandasWithState(step, "user_id long, ts timestamp, before string, after string", "last string", "append", GroupStateTimeout.NoTimeout)


def run_available(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; with ``complete``, the table at ``path`` is replaced by each batch."""
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()
