"""A response cache kept as the state of a stream: requests are answered from it, and what they bring replaces what has expired.

A key's entry is its value and the time it came. A request within ``ttl`` of that is a hit and gets the entry's value; any other is a miss, and
its own value becomes the entry. A timer in event time takes the entry away once the watermark is past its end, so keys that
nobody asks for hold no state. Whether a timer ran or not doesn't show in the answers, so they don't depend on how requests fall into batches.

Cases: requests of a key are taken by time, then by number, within a batch; batches in the order of the files, and a request older than its
key's entry is a hit; a null value is a value; a null key is a key; requests without a time are left out; repeated requests are each answered.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ANSWER = "key string, number long, at timestamp, state string, value double"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Cache(StatefulProcessor):
    def __init__(self, ttl: int) -> None:
        self.ttl = timedelta(seconds=ttl)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", "value double, at timestamp")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = pd.concat(rows).sort_values(["at", "number"], kind="stable")
        held = self.entry.get()
        value, at = held if held else (None, None)
        out, stored = [], False
        for number, time, own in asked[["number", "at", "value"]].itertuples(index=False):
            time = time.to_pydatetime()
            hit = at is not None and time < at + self.ttl
            if not hit:
                value, at, stored = None if pd.isna(own) else float(own), time, True
            out.append((key[0], number, time, "hit" if hit else "miss", value))
        if stored:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.entry.update((value, at))
            self.handle.registerTimer(int(pd.Timestamp(at + self.ttl).tz_localize("UTC").timestamp() * 1000))
        yield pd.DataFrame(out, columns=["key", "number", "at", "state", "value"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def answered(requests: DataFrame, ttl: int, late: str = "1 day") -> DataFrame:
    """Requests (key, number, at, value) of a stream with their answers: ``state``, and the ``value`` that the cache gives. Requests that are
    ``late`` by more than this may find that their batch is past."""
    timed = requests.select(F.col("key").cast("string"), "number", "at", F.col("value").cast("double")).where("at IS NOT NULL").withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(Cache(ttl), ANSWER, "append", "EventTime")


def started(spark: SparkSession, requests: DataFrame, path: str, checkpoint: str, ttl: int, late: str = "1 day") -> StreamingQuery:
    """Answers all requests that are there, from the state that the checkpoint holds, and adds the answers to a Parquet folder."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query keeps the settings that it starts with
        out = answered(requests, ttl, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return out.outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
