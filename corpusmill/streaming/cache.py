"""Time-limited caches as tables, and windowed metrics of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds that entries stay valid.
RESPONSE_TTL, RETRIEVAL_TTL, EMBEDDING_TTL = 72 * 3600, 3600, 24 * 3600
NOTHING_FOUND = "No supporting passages"


def worth_keeping(text: Column) -> Column:
    """Whether a response may be cached: it isn't empty and found something."""
    return F.coalesce((F.length(F.trim(text)) > 0) & ~F.contains(text, F.lit(NOTHING_FOUND)), F.lit(False))


def cached_at(reads: DataFrame, writes: DataFrame, key: str, ts: str, value: str, ttl_seconds: int) -> DataFrame:
    """``reads`` with the value of the last write of the key at or before it, and hit, whether it is still valid.

    ``reads`` and ``writes`` have the key and the time. Both are sorted once by key and time and the last write is
    carried forward, so there is no join by range.
    """
    r = reads.withColumn("at_", F.col(ts).cast("timestamp")).withColumn("row_", F.struct(*reads.columns)).select(key, "at_", "row_", F.lit(1).alias("kind_"), F.lit(None).cast(dict(writes.dtypes)[value]).alias("value_"))
    w = writes.select(key, F.col(ts).cast("timestamp").alias("at_"), F.lit(None).cast(r.schema["row_"].dataType).alias("row_"), F.lit(0).alias("kind_"), F.col(value).alias("value_"))
    by = Window.partitionBy(key).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("kind_") == 0, F.struct("at_", "value_")), ignorenulls=True).over(by)
    out = r.unionByName(w).withColumn("last_", last).filter("kind_ = 1")
    valid = F.coalesce(F.unix_micros("at_") - F.unix_micros("last_.at_") < ttl_seconds * 1_000_000, F.lit(False))
    return out.select("row_.*", F.when(valid, F.col("last_.value_")).alias(value), valid.alias("hit"))


def tumbling(rows: DataFrame, ts: str, every: str, groups: list[str], value: str, watermark: str | None = None) -> DataFrame:
    """(window_start, groups..., n, total, mean) of each window; on a stream, rows later than ``watermark`` are dropped."""
    timed = rows.withColumn("at_", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("at_", watermark) if watermark else timed
    out = timed.groupBy(F.window("at_", every), *groups).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").alias("window_start"), *groups, "n", "total", "mean")


def sessions(rows: DataFrame, ts: str, key: str, gap: str) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with pauses shorter than the gap."""
    timed = rows.withColumn("at_", F.col(ts).cast("timestamp"))
    out = timed.groupBy(key, F.session_window("at_", gap)).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
