"""Ordered steps of each user in a stream (an extension): who has taken required steps in order, and when.

Events wait in state until the watermark has passed them, so that events that come out of order are taken in order; a timer
at each event's time takes them then.  The state of a user is the position reached and the events still waiting; a user
who has reached the end keeps nothing but that.  Events later than the watermark are left out, as in windowed counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session needs for state with timers.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class OrderedSteps(StatefulProcessor):
    """Takes the events of a key in the order of time and emits the key when the last required step is reached."""

    def __init__(self, required: list[str]):
        self.required = required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "n int")
        self.waiting = handle.getListState("waiting", "ts bigint, step string")

    def _reached(self) -> int:
        return self.position.get()[0] if self.position.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self._reached() < len(self.required):
            for frame in rows:
                for ts, step in zip(frame["us"].tolist(), frame["step"].tolist(), strict=True):
                    self.waiting.appendValue((ts, step))
                    self.handle.registerTimer(ts // 1000 + 1)  # the first millisecond after the event
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until, position = expiredTimerInfo.getExpiryTimeInMs(), self._reached()
        if position == len(self.required):
            return
        rows = sorted(self.waiting.get())
        for ts, step in [row for row in rows if row[0] // 1000 < until]:
            if step == self.required[position]:
                position += 1
                if position == len(self.required):
                    self.position.update((position,))
                    self.waiting.clear()
                    yield pd.DataFrame({"user_id": [key[0]], "reached_at": [pd.Timestamp(ts, unit="us")]})
                    return
        self.position.update((position,))
        left = [row for row in rows if row[0] // 1000 >= until]
        self.waiting.put(left) if left else self.waiting.clear()


def ordered_steps(events: DataFrame, required: list[str], late: str = "10 minutes") -> DataFrame:
    """(user_id, reached_at) of each user whose events hold the required types in this order, others in between allowed.

    events is a stream with user_id, ts and event_type; a user comes once.  Ties in time are taken by type.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_type").alias("step"))
    kind = events.schema["user_id"].dataType.simpleString()
    return rows.groupBy("user_id").transformWithStateInPandas(OrderedSteps(required), f"user_id {kind}, reached_at timestamp", "Append", "EventTime")
