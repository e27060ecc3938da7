"""Retrieval quality and latency: hits, reciprocal ranks, percentiles, deltas and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far a metric may move before a run counts as a regression.
LIMITS = {"p95_latency": 150.0, "total_latency": 150.0, "precision_at_5": -0.05, "hit_at_5": -0.05, "mrr": -0.05}
LEAST_VALIDITY = 0.99


def matches(found: Column, expected: Column) -> Column:
    """Whether a found reference is the expected one or a range that begins with it."""
    return (found == expected) | F.startswith(found, F.concat(expected, F.lit("-")))


def relevance(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rank, hit): whether each of the ranked results (query_id, item, rank) is expected (query_id, item)."""
    want = expected.select("query_id", F.col("item").alias("want"))
    met = results.join(want, (results["query_id"] == want["query_id"]) & matches(results["item"], want["want"]), "left_semi")
    marked = results.join(met.select("query_id", "rank", F.lit(True).alias("hit_")), ["query_id", "rank"], "left")
    return marked.select("query_id", "rank", F.coalesce("hit_", F.lit(False)).alias("hit"))


def ranking_metrics(marked: DataFrame) -> DataFrame:
    """(query_id, precision_at_5, hit_at_1, hit_at_5, mrr) of ranked hits (query_id, rank, hit)."""
    top = marked.filter("rank <= 5")
    hit = F.col("hit").cast("int")
    best = marked.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    five = top.groupBy("query_id").agg(F.sum(hit).alias("hits"))
    out = best.join(five, "query_id", "left")
    return out.select(
        "query_id", F.round(F.coalesce("hits", F.lit(0)) / F.greatest(F.lit(1), F.least(F.lit(5), "n")), 6).alias("precision_at_5"), F.coalesce(F.col("first") == 1, F.lit(False)).cast("int").alias("hit_at_1"),
        F.coalesce(F.col("first") <= 5, F.lit(False)).cast("int").alias("hit_at_5"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
    )


def latency_summary(runs: DataFrame, group: str, value: str) -> DataFrame:
    """(group, runs, mean, p50, p95): the mean to two digits and nearest-rank percentiles."""
    return runs.groupBy(group).agg(
        F.count("*").alias("runs"), F.round(F.avg(value), 2).alias("mean"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95")
    )


def deltas(base: DataFrame, other: DataFrame, on: str, metrics: list[str]) -> DataFrame:
    """(on, metric..., all as other minus base)."""
    left, right = base.select(on, *[F.col(m).alias(f"{m}_a") for m in metrics]), other.select(on, *[F.col(m).alias(f"{m}_b") for m in metrics])
    return left.join(right, on).select(on, *[F.round(F.col(f"{m}_b") - F.col(f"{m}_a"), 6).alias(m) for m in metrics])


def regressions(changes: DataFrame, on: str, limits: dict[str, float] | None = None) -> DataFrame:
    """(on, metric, change): metrics that moved beyond their limit; a positive limit bounds a rise, a negative a fall."""
    limits = {m: v for m, v in (LIMITS if limits is None else limits).items() if m in changes.columns}
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("change"), F.lit(float(v)).alias("limit")) for m, v in limits.items()])
    long = changes.select(on, F.explode(cells).alias("c")).select(on, "c.*")
    return long.filter(F.when(F.col("limit") >= 0, F.col("change") > F.col("limit")).otherwise(F.col("change") < F.col("limit"))).drop("limit")


def utilisation(cited: DataFrame, retrieved: DataFrame, within: str, item: str) -> DataFrame:
    """(within, retrieved, cited, utilisation): the share of retrieved items that are cited, two digits."""
    have = retrieved.select(within, item).distinct()
    used = cited.select(within, item).distinct().join(have, [within, item], "left_semi").groupBy(within).agg(F.count("*").alias("cited"))
    out = have.groupBy(within).agg(F.count("*").alias("retrieved")).join(used, within, "left").withColumn("cited", F.coalesce("cited", F.lit(0)))
    return out.withColumn("utilisation", F.round(F.col("cited") / F.col("retrieved"), 2))


def integrity(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, failed): how many rows fail each condition; null counts as failing."""
    sums = rows.agg(*[F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0)).alias(n) for n, c in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failed")) for n in checks])).alias("c")).select("c.*")
