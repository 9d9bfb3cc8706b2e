"""Incremental import as Structured Streaming: mail or files in, documents and audit rows out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import mail_import
from ..sources import mail
from ..sources.mail_stream import MailSource

ITEMS = "id long, run_id string, message_id string, status string, created_at timestamp"


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(ITEMS).json(path)


def first_seen(items: DataFrame, delay: str = "1 day") -> DataFrame:
    """Items once a message and id, with state kept for ``delay`` only."""
    return items.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["message_id", "id"])


def counts_by_window(items: DataFrame, width: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Items by status and time window; a window closes once the watermark passes it."""
    rows = items.withWatermark("created_at", delay).groupBy(F.window("created_at", width), "status")
    return rows.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "status", "n")


def import_available(items: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append all that is there now and stop; offsets in ``checkpoint`` make a rerun add nothing."""
    return items.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def mail_stream(spark: SparkSession, client: str, config: mail.MailConfig, after_ms: int | None = None, **options: str) -> DataFrame:
    """New messages as a stream; ``client`` names a function as ``package.module:function``,
    which may take the options of the stream."""
    spark.dataSource.register(MailSource)
    asked = spark.readStream.format("pressmill_mail").option("client", client).option("query", config.query).option("maxResults", str(config.max_results)).option("includeSpam", str(config.include_spam)).option("labels", ",".join(config.label_ids)).options(**options)
    return (asked.option("afterMs", str(after_ms)) if after_ms is not None else asked).load()


def import_stream(messages: DataFrame, root: str, config: mail.MailConfig, make: Callable, checkpoint: str, clock: Callable[[], str], fallback_year: int, name: str = "mail", after: Callable[[str], None] | None = None) -> StreamingQuery:
    """Every batch of messages is one import run, named by its number.

    A batch that is run again after a crash writes the same rows to the same places;
    one whose run had ended before the query noted it adds nothing."""

    def one(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            mail_import.run_import(batch.sparkSession, root, f"{name}-{number}", batch, config, make, clock(), fallback_year, trigger="stream", after=after)

    return messages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lease_watch(events: DataFrame, lease_ms: int, delay: str = "1 second") -> DataFrame:
    """(key, event, at): a key that starts, and neither ends nor renews within its lease,
    is stale at the lease's end.

    ``events``: (key string, event 'start' | 'renew' | 'end', at timestamp).  State is one
    deadline a key, with a timer on event time: it fires once the watermark passes it.  A
    renewal of what doesn't run, or an end of it, does nothing; events older than the
    watermark are late and not seen, so an end that comes too late takes nothing back.
    Timers need the RocksDB store of states, which is set here if none is."""
    spark = events.sparkSession
    if "spark.sql.streaming.stateStore.providerClass" not in spark.conf.getAll or "HDFS" in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept = events.withWatermark("at", delay).groupBy("key")
    return kept.transformWithStateInPandas(_Leases(lease_ms), "key string, event string, at timestamp", "append", "eventTime")


class _Leases(StatefulProcessor):
    def __init__(self, lease_ms: int):
        self.lease_ms = lease_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "due long")

    def _until(self, due: int | None) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
            self.due.clear()
        if due is not None:
            self.due.update((due,))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # One batch of a key: its events of a trigger, in order.
        seen = pd.concat(list(rows)).sort_values(["at", "event"])
        for event, at in zip(seen["event"], seen["at"], strict=True):
            due = int(at.timestamp() * 1000) + self.lease_ms
            if event == "start" or (event == "renew" and self.due.exists()):
                self._until(due)
            elif event == "end":
                self._until(None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        self.due.clear()
        text = lambda x: pd.Series([x], dtype=object)
        yield pd.DataFrame({"key": text(key[0]), "event": text("stale"), "at": [pd.Timestamp(due, unit="ms")]})

    def close(self) -> None:
        """Nothing is held outside the state."""
