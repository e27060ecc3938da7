"""Top N items within every group, split into hot and cold groups.

Exact group counts separate the few heavy groups from the rest. Light groups go through one ordinary window. The score
range of every heavy group is cut at quantiles, and each range, salted, is sorted as a part of its own, so no task sorts
a heavy group; the at most N winners of each part are ranked again. Parts beyond the first N rows of a task are
dropped before the exchange, by the limit of the ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

#: At most so many groups are heavy, which bounds the broadcast of their keys and ranges.
MAX_HEAVY_GROUPS = 50_000
#: Shares of a heavy group's rows at which its score range is cut.
RANGE_CUTS = (0.5, 0.9, 0.99, 0.999)


def top_n_per_group(df: DataFrame, groups: list[str], score: str, item: str, n: int, heavy_rows: int = 1_000, salts: int = 16) -> DataFrame:
    """The ``n`` items of each group with the highest score: (groups..., item, score, place), place from 1.

    Rows with a null score, item or group column take no part; NaN scores count as null. Equal scores are ordered by
    item, smallest first. A repeated (group, item, score) counts once; an item that repeats with another score is
    another entry. Fewer than ``n`` items give all; an empty table gives an empty result. Columns other than those
    named are ignored, whatever their names. Groups of more than ``heavy_rows`` rows are heavy, of more where that would
    make over ``MAX_HEAVY_GROUPS``; both ways give the same rows.
    """
    keys = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)], F.col(item).alias("item"), F.col(score).alias("score"))
    rows = rows.dropna(how="any")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows")).first()[0] or 0
    heavy = counts.filter(F.col("rows") > max(heavy_rows, -(-total // MAX_HEAVY_GROUPS))).select(*keys)
    heavy = cut_lineage(heavy)
    found = rows.join(F.broadcast(heavy), keys)
    edges = found.groupBy(*keys).agg(F.percentile_approx("score", list(RANGE_CUTS), 1_000).alias("edges"))
    best = _ranked(rows.join(F.broadcast(heavy), keys, "left_anti"), keys, n).unionByName(_heavy(found, edges, keys, n, salts))
    return best.select(*[F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)], F.col("item").alias(item), F.col("score").alias(score), "place")


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("item").asc()]


def _near(rows: DataFrame, parts: list[str], keys: list[str], n: int) -> DataFrame:
    """The distinct first ``n`` entries of each part; the limit is applied before and after the exchange."""
    place = F.dense_rank().over(Window.partitionBy(*parts).orderBy(*_order()))
    return rows.withColumn("near", place).filter(F.col("near") <= n).dropDuplicates([*parts, "item", "score"]).select(*keys, "item", "score", "near")


def _ranked(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Copies share a dense rank, so it is the place among distinct entries."""
    return _near(rows, keys, keys, n).withColumnRenamed("near", "place")


def _heavy(rows: DataFrame, edges: DataFrame, keys: list[str], n: int, salts: int) -> DataFrame:
    ranged = rows.join(F.broadcast(edges), keys)  # one row per heavy group
    ranged = ranged.withColumn("range", F.size(F.filter("edges", lambda e: F.col("score") >= e))).drop("edges")
    ranged = ranged.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts)))
    return _ranked(_near(ranged, [*keys, "range", "salt"], keys, n).drop("near"), keys, n)
