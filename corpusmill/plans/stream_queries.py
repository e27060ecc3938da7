"""Streams over the events table: read as a stream, run until it is used up, and compared with SQL over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.plans.registry import query
from corpusmill.session import scratch
from corpusmill.sources import readers as rd
from corpusmill.streaming import cache as ca
from corpusmill.streaming import limits as li


def _stream(t, name: str) -> DataFrame:
    """A table's file, or the files of its folder, as a stream."""
    path = t.path(name)
    where = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = t.spark.readStream.schema(t(name).schema)
    if where.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(path.rpartition("/")[0])


def _used_up(t, rows: DataFrame, mode: str) -> DataFrame:
    """The result of a stream once all input is read; in complete mode the last one."""
    out, state = scratch(t.spark, "stream-out"), scratch(t.spark, "stream-state")
    sink = rows.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "complete":
        sink = sink.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out))
    else:
        sink = sink.format("parquet").option("path", out)
    sink.start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out)


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def x9_stream_metrics(t):
    out = _used_up(t, ca.tumbling(_stream(t, "events"), "ts", "1 hour", ["event_type"], "value"), "complete")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events WHERE user_id IS NOT NULL")
def x7_stream_without_repeats(t):
    """Requests whose user and kind are pending already are dropped; all events are within the time that counts."""
    rows = _stream(t, "events").filter("user_id is not null").select("user_id", "event_type", "ts")
    return _used_up(t, li.without_repeats(rows, "ts", ["user_id", "event_type"], "90 days"), "append").select("user_id", "event_type")


@query("SELECT row_id, pos::INT AS at, substr(text, pos * 220 + 1, 220) AS chunk FROM (SELECT row_id, text, unnest(range(greatest(1, ceil(length(text) / 220.0))::INT)) AS pos FROM verses WHERE text IS NOT NULL)")
def x8_chunks(t):
    """A cached text as the chunks in which it is handed out."""
    return t("verses").filter("text is not null").select("row_id", F.posexplode(tx.chunks(F.col("text"))).alias("at", "chunk"))


@query("SELECT upper(embedding_model) AS embedding_model, max_chars, max_verses, overlap_verses FROM embed_models")
def s1_first_existing_table(t):
    """A JSON table from the first of several paths that exists, and none from a path that doesn't: S1, S2, S5, S7."""
    path, schema = scratch(t.spark, "models"), t("embed_models").schema
    t("embed_models").coalesce(1).write.option("compression", "gzip").json(path)
    there = rd.json_table(t.spark, [path + "-none", path], schema, lines=True)
    return there.unionByName(rd.json_table(t.spark, [path + "-none"], schema)).withColumn("embedding_model", F.upper("embedding_model"))


@query(
    """WITH w AS (SELECT doc_id, unnest([x FOR x IN string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+') IF x <> '']) AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, (('0x' || substr(md5(t), 1, 4))::INT % 64)::INT AS at, sum(CASE WHEN ('0x' || substr(md5(t), 5, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS value FROM w GROUP BY 1, 2 HAVING value <> 0"""
)
def s24_hashed_vectors(t):
    made = tx.hashed_vectors(t("documents"), "doc_id", "text", 64)
    return made.select("doc_id", F.posexplode("vector").alias("at", "value")).filter("value <> 0")
