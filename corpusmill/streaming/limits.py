"""Rate limits over events: fixed windows anchored at the first request, sliding windows, windows after the last one.

Each rule comes as a batch operator over a table and, where it holds state, as a Structured Streaming operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_MS, LIMIT, WARN = 60_000, 60, 50


def millis(rows: DataFrame, ts: str) -> DataFrame:
    """``rows`` with ms: epoch milliseconds of a timestamp with or without a zone."""
    return rows.withColumn("ms", F.unix_millis(F.col(ts).cast("timestamp")))


def sliding_log(rows: DataFrame, key: str, ts: str, event: str, window_ms: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """(key, event, ms, count, allowed): requests of the key in the window that ends with this one.

    A request exactly ``window_ms`` old has left the window. Requests at the same millisecond count in the order of
    their ids. A null key is a key.
    """
    timed = millis(rows, ts)
    order = Window.partitionBy(key).orderBy("ms")
    near = F.count("*").over(order.rangeBetween(-(window_ms - 1), 0))
    same = F.count("*").over(Window.partitionBy(key, "ms"))
    turn = F.row_number().over(Window.partitionBy(key, "ms").orderBy(event))
    out = timed.withColumn("count", near - same + turn)
    return out.select(key, event, "ms", "count", (F.col("count") <= limit).alias("allowed"))


def after_last(rows: DataFrame, key: str, ts: str, event: str, window_ms: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """(key, event, ms, count, allowed): requests since the last pause of ``window_ms``, which every request puts off."""
    by = Window.partitionBy(key).orderBy("ms", event)
    timed = millis(rows, ts)
    begins = F.coalesce(F.col("ms") - F.lag("ms").over(by) >= window_ms, F.lit(True))
    runs = timed.withColumn("run_", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    counted = runs.withColumn("count", F.row_number().over(Window.partitionBy(key, "run_").orderBy("ms", event)).cast("long"))
    return counted.select(key, event, "ms", "count", (F.col("count") <= limit).alias("allowed"))


def anchored(rows: DataFrame, key: str, ts: str, event: str, window_ms: int = WINDOW_MS, limit: int = LIMIT, warn: int = WARN) -> DataFrame:
    """(key, event, ms, window_start, count, allowed, warned): a window opens with the first request after the last closed.

    Denied requests count. The anchor depends on all requests before, so rows stream through each partition in order of
    key and time with one open window at a time; no key is ever held as a whole.
    """
    kind = dict(rows.dtypes)
    timed = millis(rows, ts).select(key, event, "ms").filter(F.col("ms").isNotNull())
    ordered = timed.repartition(F.col(key)).sortWithinPartitions(key, "ms", event)

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, count = object(), None, 0
        for part in parts:
            starts, counts = [], []
            for k, ms in zip(part[key], part["ms"], strict=True):
                if k != now or start is None or ms - start >= window_ms:
                    now, start, count = k, ms, 0
                count += 1
                starts.append(start)
                counts.append(count)
            out = part.assign(window_start=starts, count=counts)
            yield out.assign(allowed=out["count"] <= limit, warned=out["count"] > warn)[[key, event, "ms", "window_start", "count", "allowed", "warned"]]

    return ordered.mapInPandas(walk, f"{key} {kind[key]}, {event} {kind[event]}, ms long, window_start long, count long, allowed boolean, warned boolean")


class SlidingProcessor(StatefulProcessor):
    """Keeps the times of a key's requests within the window."""

    def __init__(self, key: str, event: str, window_ms: int, limit: int, event_type: str):
        self.key, self.event, self.window_ms, self.limit, self.event_type = key, event, window_ms, limit, event_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "ms long", self.window_ms + 300_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values(["ms", self.event], kind="stable")
        log = [t for (t,) in self.times.get()] if self.times.exists() else []
        counts = []
        for ms in part["ms"]:
            log = [t for t in log if ms - t < self.window_ms] + [int(ms)]
            counts.append(len(log))
        self.times.put([(t,) for t in log])
        yield pd.DataFrame({self.key: [key[0]] * len(part), self.event: part[self.event], "ms": part["ms"], "count": counts, "allowed": [c <= self.limit for c in counts]})

    def close(self) -> None:
        pass


def sliding_stream(rows: DataFrame, key: str, ts: str, event: str, window_ms: int = WINDOW_MS, limit: int = LIMIT) -> DataFrame:
    """``sliding_log`` of a stream; needs the RocksDB state store. Requests count in order of arrival by batch, and by
    time within a batch; state a few minutes older than the window is dropped."""
    kind = dict(rows.dtypes)
    processor = SlidingProcessor(key, event, window_ms, limit, kind[event])
    timed = millis(rows, ts).select(key, event, "ms")
    return timed.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind[key]}, {event} {kind[event]}, ms long, count long, allowed boolean", "append", "processingTime")


def without_repeats(rows: DataFrame, ts: str, keys: list[str], within: str) -> DataFrame:
    """A stream without requests whose keys were seen within a time of each other; late rows beyond it are dropped."""
    return rows.withColumn("at_", F.col(ts).cast("timestamp")).withWatermark("at_", within).dropDuplicatesWithinWatermark(keys).drop("at_")
