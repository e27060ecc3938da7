import datetime as dt
import random

from pyspark.sql import functions as F

from corpusmill.streaming import cache, limits

START = dt.datetime(2025, 1, 1)


def events(spark, offsets, key="u"):
    return spark.createDataFrame([(i, key, START + dt.timedelta(milliseconds=ms)) for i, ms in enumerate(offsets)], "event long, k string, ts timestamp_ntz")


def test_sliding_log_edges(spark):
    rows = events(spark, [0, 59_999, 60_000, 60_000])
    got = [(r["event"], r["count"]) for r in limits.sliding_log(rows, "k", "ts", "event").orderBy("event").collect()]
    assert got == [(0, 1), (1, 2), (2, 2), (3, 3)]


def test_anchored_window_against_brute_force(spark):
    rng = random.Random(5)
    offsets = sorted(rng.randrange(400_000) for _ in range(300))
    rows = events(spark, offsets).unionByName(events(spark, offsets[:50], None))
    start, count, want = None, 0, []
    for ms in offsets:
        if start is None or ms - start >= 60_000:
            start, count = ms, 0
        count += 1
        want.append(count)
    out = limits.anchored(rows, "k", "ts", "event", limit=20, warn=10).collect()
    got = sorted((r["event"], r["count"], r["allowed"], r["warned"]) for r in out if r["k"] == "u")
    assert [g[1] for g in got] == want and all(g[2] == (g[1] <= 20) and g[3] == (g[1] > 10) for g in got)
    assert sum(r["k"] is None for r in out) == 50


def test_sixty_first_request_is_denied(spark):
    rows = events(spark, [i * 900 for i in range(61)])
    assert [r["event"] for r in limits.anchored(rows, "k", "ts", "event").filter("not allowed").collect()] == [60]


def test_window_after_the_last(spark):
    got = limits.after_last(events(spark, [0, 50_000, 100_000, 160_000]), "k", "ts", "event").orderBy("event").collect()
    assert [r["count"] for r in got] == [1, 2, 3, 1]


def test_cache_lookup(spark):
    reads, writes = events(spark, [5, 1_000, 20_000]), events(spark, [5, 900]).withColumn("v", F.concat(F.lit("v"), "event"))
    got = cache.cached_at(reads, writes.select("k", "ts", "v"), "k", "ts", "v", 10).orderBy("event").collect()
    assert [(r["v"], r["hit"]) for r in got] == [("v0", True), ("v1", True), (None, False)]


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events(spark, [i * 7_000 for i in range(40)])
    rows.write.parquet(str(tmp_path / "in"))
    stream = limits.sliding_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "ts", "event", limit=5)
    query = stream.writeStream.format("memory").queryName("sliding").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = sorted((r["event"], r["count"], r["allowed"]) for r in spark.table("sliding").collect())
    assert got == sorted((r["event"], r["count"], r["allowed"]) for r in limits.sliding_log(rows, "k", "ts", "event", limit=5).collect())


def test_repeats_within_watermark(spark, tmp_path):
    rows = events(spark, [0, 1_000, 2_000]).withColumn("request", F.when(F.col("event") < 2, "a").otherwise("b"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = limits.without_repeats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", ["request"], "1 minute")
    query = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r["request"] for r in spark.table("once").collect()) == ["a", "b"]
    tumbled = cache.tumbling(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "1 minute", ["k"], "event", "1 minute")
    assert tumbled.isStreaming
