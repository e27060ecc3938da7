"""Set operators on ordered lists and on tables: prepend, replace, overwrite, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_distinct(first: DataFrame, second: DataFrame, keys: list[Column], *order: str) -> DataFrame:
    """All rows of both, each key at its first place: rows of ``first`` before those of ``second``."""
    rows = first.withColumn("list_", F.lit(0)).unionByName(second.withColumn("list_", F.lit(1)))
    by = Window.partitionBy(*keys).orderBy("list_", *order)
    return rows.withColumn("first_", F.row_number().over(by)).filter("first_ = 1").drop("first_", "list_")


def prepend(priority: DataFrame, retrieved: DataFrame, within: str, item: str, order: str, excluded: DataFrame | None = None) -> DataFrame:
    """(within, item, place): priority items first, then the retrieved ones that are neither among them nor excluded.

    ``excluded`` has (within, item). Priority items are kept even if excluded.
    """
    rest = retrieved.join(priority.select(within, item), [within, item], "left_anti")
    if excluded is not None:
        rest = rest.join(excluded.select(within, item), [within, item], "left_anti")
    rows = priority.select(within, item, F.lit(0).alias("list_"), F.col(order).alias("ord_")).unionByName(rest.select(within, item, F.lit(1).alias("list_"), F.col(order).alias("ord_")))
    rows = rows.groupBy(within, item).agg(F.min(F.struct("list_", "ord_")).alias("at_"))
    return rows.select(within, item, F.row_number().over(Window.partitionBy(within).orderBy("at_", item)).alias("place"))


def overwrite(base: DataFrame, later: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both by key, the later table's replacing the earlier's."""
    return later.unionByName(base.join(later.select(*on), on, "left_anti"))


def upsert(existing: DataFrame, incoming: DataFrame, on: list[str], replace: list[str], keep_if_null: list[str] = [], order: str | None = None) -> DataFrame:  # noqa: B006
    """``existing`` with ``incoming`` merged by key.

    Columns of ``replace`` take the incoming value, those of ``keep_if_null`` only a non-null one. Of incoming rows that
    share a key the last by ``order`` counts. Keys compare null-safe, so a null key part is a value. One shuffle per side.
    """
    new = incoming
    if order:
        by = Window.partitionBy(*on).orderBy(F.col(order).desc())
        new = new.withColumn("last_", F.row_number().over(by)).filter("last_ = 1").drop("last_")
    columns = [*on, *replace, *keep_if_null]
    left, right = existing.select(*columns).alias("l"), new.select(*columns, F.lit(True).alias("new_")).alias("r")
    match = F.lit(True)
    for c in on:
        match = match & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    both = left.join(right, match, "full_outer")
    is_new = F.coalesce(F.col("r.new_"), F.lit(False))

    def pick(c: str) -> Column:
        if c in on:
            return F.when(is_new, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))
        if c in replace:
            return F.when(is_new, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}"))
        return F.coalesce(F.col(f"r.{c}"), F.col(f"l.{c}"))

    return both.select(*[pick(c).alias(c) for c in columns])


def insert_missing(existing: DataFrame, incoming: DataFrame, on: list[str]) -> DataFrame:
    """``existing`` with the incoming rows whose key is new, each once."""
    new = incoming.join(existing.select(*on), on, "left_anti").dropDuplicates(on)
    return existing.unionByName(new)


def ordered_cross(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Every pair of two arrays of a row, as two columns; rows with an empty or null array give none."""
    return rows.withColumn(left, F.explode(left)).withColumn(right, F.explode(right))
