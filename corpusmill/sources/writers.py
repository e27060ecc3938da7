"""Sinks: partitioned tables, versioned envelopes, skipping unchanged builds, reports and event rows."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_partitioned(rows: DataFrame, path: str, by: list[str], sort: list[str]) -> None:
    """A Parquet table partitioned by few-valued columns, each partition clustered and sorted for pruning."""
    rows.repartition(*by).sortWithinPartitions(*by, *sort).write.mode("overwrite").partitionBy(*by).option("compression", "zstd").parquet(path)


@dataclass(frozen=True)
class Envelope:
    """What a dataset says about itself."""

    version: str
    generator: str
    source_hash: str = ""


def write_envelope(spark: SparkSession, rows: DataFrame, path: str, envelope: Envelope) -> None:
    """The table, and beside it one row with version, generator and source hash."""
    rows.write.mode("overwrite").parquet(f"{path}/items")
    spark.createDataFrame([(envelope.version, envelope.generator, envelope.source_hash)], "version string, generator string, source_hash string").coalesce(1).write.mode("overwrite").json(f"{path}/envelope")


def read_envelope(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The table, if its version is the expected one; else an error."""
    found = spark.read.schema("version string, generator string, source_hash string").json(f"{path}/envelope").first()
    if found is None or found["version"] != version:
        raise ValueError(f"dataset version {None if found is None else found['version']}, expected {version}")
    return spark.read.parquet(f"{path}/items")


def unchanged(spark: SparkSession, path: str, source_hash: str) -> bool:
    """Whether the table was built from sources with this hash."""
    try:
        found = spark.read.schema("version string, generator string, source_hash string").json(f"{path}/envelope").first()
    except Exception:  # the path isn't there
        return False
    return found is not None and found["source_hash"] == source_hash


def require_schema(rows: DataFrame, expected: T.StructType) -> DataFrame:
    """``rows`` if they have the expected columns and types, whatever else; an error otherwise."""
    have = {f.name: f.dataType for f in rows.schema}
    wrong = [f.name for f in expected if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns missing or of another type: {', '.join(wrong)}")
    return rows


def event_rows(rows: DataFrame, event: str, *fields: str | Column) -> DataFrame:
    """(event, body): each row as one JSON object."""
    return rows.select(F.lit(event).alias("event"), F.to_json(F.struct(*fields)).alias("body"))


def report(rows: DataFrame, title: str, most: int = 200) -> tuple[str, str]:
    """A small summary table as JSON and as a Markdown table; at most ``most`` rows, else an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]
    return json.dumps({"title": title, "rows": [r.asDict(recursive=True) for r in found]}, default=str, ensure_ascii=False), "\n".join(lines)
