"""Ranks and running sums within keys that may hold a large share of all rows.

A key's rows are split into parts that keep the order: all of one part stand before all of the next. Sizes or sums of
parts are aggregated first, so that only the parts, and never a whole key, are sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the whole range of an ordering column is cut.
RANGE_PARTS = 256


def place_in_parts(rows: DataFrame, keys: list[str], coarse: list[tuple[Column, bool]], fine: list[Column], out: str = "place") -> DataFrame:
    """``rows`` with ``out``, the place from 1 within the key in the order of ``coarse`` and then ``fine``.

    ``coarse`` are pairs of an expression and whether it falls; rows that agree on all of them form a part.
    """
    names = [f"part_{i}_" for i in range(len(coarse))]
    plain = [c for c, _ in coarse]
    order = [F.col(n).desc() if down else F.col(n).asc() for n, (_, down) in zip(names, coarse, strict=True)]
    split = rows.withColumns(dict(zip(names, plain, strict=True)))
    sizes = split.groupBy(*keys, *names).agg(F.count("*").alias("size_"))
    before = F.coalesce(F.sum("size_").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"o_{c}") for c in [*keys, *names]], before.alias("before_"))
    own = split.withColumn("own_", F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*fine)))
    same = F.lit(True)
    for c in [*keys, *names]:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    met = own.join(offsets, same)
    return met.withColumn(out, (F.col("before_") + F.col("own_")).cast("int")).drop(*names, "own_", "before_", *[f"o_{c}" for c in [*keys, *names]])


def range_part(rows: DataFrame, column: str, parts: int = RANGE_PARTS) -> Column:
    """An order-preserving part of a column: for numbers and times an equal share of the whole range, else a prefix."""
    kind = dict(rows.dtypes)[column]
    if kind in ("string",):
        return F.substring(column, 1, 4)
    value = F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.col(column).cast("double")
    ends = rows.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if ends["low"] is None or ends["high"] <= ends["low"]:
        return F.lit(0)
    return F.floor((value - ends["low"]) / ((ends["high"] - ends["low"]) / parts)).cast("int")
