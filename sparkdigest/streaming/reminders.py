"""Reminders as a stream: each attempt waits for its instant by an event-time timer, then is sent or expires."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ["calendar_id", "instance_id", "rule_id"]
OUT = "calendar_id string, instance_id long, rule_id string, reminder_at timestamp, action string"
STATE = "reminder_us long, start_us long"


def due_stream(attempts: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """attempts(calendar_id, instance_id, rule_id, reminder_at, start, now) to OUT, each attempt once.

    now is the event time of a row: when the schedule was read. The watermark stands for the clock; when it passes an
    attempt's instant, the attempt is sent, or expires if its event has begun. A later row of the same key moves the
    reminder; state goes with the timer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            reminder, start = state.get
            clock = state.getCurrentWatermarkMs() * 1000
            state.remove()
            action = "expire" if start <= clock else "send"
            yield pd.DataFrame({"calendar_id": [key[0]], "instance_id": [key[1]], "rule_id": [key[2]], "reminder_at": pd.to_datetime([reminder], unit="us"), "action": [action]})
            return
        last = None
        for rows in batches:
            last = rows.sort_values("now").iloc[-1]
        if last is not None:
            reminder, start = (int(pd.Timestamp(last[c]).value // 1000) for c in ("reminder_at", "start"))
            state.update((reminder, start))
            # a timer fires once the watermark is beyond it: one earlier, so that the instant itself counts
            state.setTimeoutTimestamp(max(reminder // 1000 - 1, state.getCurrentWatermarkMs() + 1))

    watched = attempts.withWatermark("now", delay)
    return watched.groupBy(*KEYS).applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def dispatch_batch(attempts: DataFrame, now) -> DataFrame:
    """The same decision for a table at one instant."""
    due = attempts.where(F.col("reminder_at") <= now)
    return due.withColumn("action", F.when(F.col("start") <= now, "expire").otherwise("send"))


def deliver(stream: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1 minute"):
    """Start a query that hands each batch and its number to `send`; a batch that is tried again has the same number.

    every=None takes what is there and stops, as a daily job does.
    """
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(send)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def undelivered(chunks: DataFrame, delivered: DataFrame, key: str = "delivery_id") -> DataFrame:
    """Chunks (key, chunk_no) that a delivery still has to send: those after the ones that were delivered."""
    done = delivered.groupBy(key).agg(F.max("chunk_no").alias("_done"))
    return chunks.join(done, key, "left").where(F.col("chunk_no") > F.coalesce("_done", F.lit(0))).drop("_done")


def new_documents(documents: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """Documents of a stream once each by key, within a watermark on published_at."""
    return documents.withWatermark("published_at", late).dropDuplicatesWithinWatermark(keys)
