"""Recent changes of each key as a stream with bounded state."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from civicrill.sources.shared import fresh_path

#: Changes that a key remembers, for how long before the newest, and how long state of a silent key lives (milliseconds).
KEEP, AGE, TTL = 5, timedelta(days=7), 90 * 24 * 3600 * 1000
#: Times are microseconds within the processor.
CHANGE = "user_id long, event_id long, ts long, before string, after string, kept int, oldest long"
#: State that may expire needs this store; a stream whose state may expire would otherwise ask for empty batches without end.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def _processor() -> StatefulProcessor:
    """An object of a class of this function, which is sent to the stream's workers by value: they need not find this package."""
    age = AGE // timedelta(microseconds=1)

    class RecentChanges(StatefulProcessor):
        """The last event of a key and the times of its last changes, KEEP at most, in one value: a key and batch cost one question and one answer to the store."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("recent", "ts long, event_id long, event_type string, changes array<long>", TTL)

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
            last = self.state.get()
            kept = list(last[3]) if last is not None else []
            # no frame for a key: most have a few rows
            for ts, event_id, event_type in sorted((r["ts"], r["event_id"], r["event_type"]) for r in rows):
                # what is delivered again or late has been counted or can no longer be placed
                if last is not None and (ts, event_id) <= (last[0], last[1]):
                    continue
                if last is not None and event_type != last[2]:
                    kept = [t for t in [*kept, ts] if t > ts - age][-KEEP:]
                    yield Row(user_id=key[0], event_id=event_id, ts=ts, before=last[2], after=event_type, kept=len(kept), oldest=kept[0])
                last = (ts, event_id, event_type)
            if last is not None:
                self.state.update((*last, kept))

        def close(self) -> None:
            pass

    return RecentChanges()


def recent_changes(stream: DataFrame) -> DataFrame:
    """user_id, event_id, ts, before, after, kept, oldest: a row whenever a user's event type differs from the one before.

    kept counts the changes remembered with this one, KEEP at most and none older than AGE; oldest is the first of them.
    Events of a user in one batch are put in order; an event not after the last one that was seen (late, or delivered
    again) is left out. Rows with a null in user_id, ts, event_id
    or event_type are left out.
    """
    known = stream.filter("user_id is not null and ts is not null and event_id is not null and event_type is not null")
    rows = known.select("user_id", F.unix_micros("ts").alias("ts"), "event_id", "event_type")
    changes = rows.groupBy("user_id").transformWithState(_processor(), CHANGE, "Append", "ProcessingTime")
    return changes.withColumns({c: F.timestamp_micros(c) for c in ("ts", "oldest")})


def drained(result: DataFrame, spark: SparkSession, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Process all that is there, stop, and read the rows back; state and rows lie in the shared folder, or where told."""
    before = {k: spark.conf.get(k) for k in _SETTINGS}
    path = path or fresh_path(spark, "stream")
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        writer = result.writeStream.outputMode("append").option("checkpointLocation", checkpoint or fresh_path(spark, "state"))
        writer.trigger(availableNow=True).format("parquet").option("path", path).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(result.schema).parquet(path)
