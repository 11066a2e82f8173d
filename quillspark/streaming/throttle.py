"""At most one commit in a while for each key: over a table by a fold, over a stream by a timer."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The provider of states that processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def throttled(events: DataFrame, key: str, time: str, order: str, seconds: int = 60) -> DataFrame:
    """The ``events`` that are commits: a key's first one, and each that comes ``seconds`` or more after the commit before it; equal times in ``order``. Rows without a
    time are none.

    An event that comes so long after the event before it is a commit whatever that one was. So a key's events are cut there, and the fold
    runs over a stretch of close ones, not over all that a key has."""
    own = Window.partitionBy(key).orderBy(time, order)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    timed = events.where(F.col(time).isNotNull()).withColumn("_at", at)
    apart = F.coalesce(F.col("_at") - F.lag("_at").over(own) >= seconds * 1_000_000, F.lit(True))
    stretches = timed.withColumn("_stretch", F.sum(apart.cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("_at", F.col(order).alias("_order"), F.struct(*(F.col(f"`{c}`") for c in events.columns)).alias("_row"))
    order_of = lambda a, b: F.when(a["_at"] != b["_at"], F.signum(a["_at"] - b["_at"]).cast("int")).when(a["_order"] < b["_order"], -1).when(a["_order"] > b["_order"], 1).otherwise(0)
    held = stretches.groupBy(F.col(key).alias("_key"), "_stretch").agg(F.array_sort(F.collect_list(row), order_of).alias("_rows"))

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        return F.when(last.isNull() | (F.get("_rows", x)["_at"] - F.get("_rows", last)["_at"] >= seconds * 1_000_000), F.array_append(done, x)).otherwise(done)

    kept = F.aggregate(F.sequence(F.lit(0), F.size("_rows") - 1), F.array().cast("array<int>"), step)
    return held.select(F.explode(F.transform(kept, lambda i: F.get("_rows", i)["_row"])).alias("_row")).select("_row.*")


class Throttle(StatefulProcessor):
    """Holds the time of a key's last commit, until the watermark has passed the time from which any event is a commit again."""

    def __init__(self, key: str, time: str, order: str, seconds: int, state: str):
        self.key, self.time, self.order, self.gap, self.state = key, time, order, pd.Timedelta(seconds=seconds), state

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(self.last.get()[0]) if self.last.exists() else None
        events = pd.concat(list(rows)).sort_values([self.time, self.order])
        kept = []
        for k, at in enumerate(events[self.time]):
            if last is None or at - last >= self.gap:
                kept.append(k)
                last = at
        if kept:
            self.last.update((last.to_pydatetime(),))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((last + self.gap - pd.Timestamp(0)) / datetime.timedelta(milliseconds=1)))
        yield events.iloc[kept]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, key: str, time: str, order: str, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """The commits of a stream of ``events``, as ``throttled`` has them where events come in order of time. An event that comes before the key's last commit is none, whenever
    it comes; one that is later than ``delay`` behind the newest is dropped. The session's state store must be ``PROVIDER``."""
    watched = events.withWatermark(time, delay)
    processor = Throttle(key, time, order, seconds, StructType([events.schema[time]]).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    return watched.groupBy(key).transformWithStateInPandas(processor, events.schema, "Append", "EventTime")
