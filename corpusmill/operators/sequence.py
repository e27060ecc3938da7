"""Order-dependent operators: windows over neighbours, islands, first-wins distinct, prefix budgets, merges."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import collapse, token_estimate
from corpusmill.operators.ranking import range_part

WINDOW_REACH = 2
MERGE_OVERLAP = 0.6


def first_wins(rows: DataFrame, keys: list[str | Column], *order: str | Column, within: list[str] | None = None) -> DataFrame:
    """The first row of every key in an order, nulls counting as one key; with ``within``, per group."""
    by = Window.partitionBy(*(within or []), *keys).orderBy(*order)
    return rows.withColumn("first_", F.row_number().over(by)).filter("first_ = 1").drop("first_")


def frames(rows: DataFrame, groups: list[str], order: str, item: str, text: str, reach: int = WINDOW_REACH) -> DataFrame:
    """``rows`` with ids and text of the rows from ``reach`` before to ``reach`` after, clipped at the group's ends.

    Null items and texts are left out of the collected values.
    """
    around = Window.partitionBy(*groups).orderBy(order, item).rowsBetween(-reach, reach)
    return rows.withColumn("window_ids", F.collect_list(item).over(around)).withColumn("window_text", F.array_join(F.collect_list(text).over(around), " "))


def neighbours(keys: DataFrame, rows: DataFrame, groups: list[str], position: str, reach: int = 1) -> DataFrame:
    """Rows whose position lies within ``reach`` of a key's, by value: positions below 1 don't exist.

    ``keys`` has the group columns, the position and ``ord``; the result is each found row once per group, with the
    least (ord, distance from the first) as ``ord`` and ``step``.
    """
    wanted = keys.withColumn("step", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    wanted = wanted.withColumn(position, F.col(position) + F.col("step")).filter(F.col(position) >= 1)
    wanted = wanted.groupBy(*groups, position).agg(F.min(F.struct("ord", "step")).alias("place"))
    return rows.join(wanted, [*groups, position]).withColumn("ord", F.col("place")["ord"]).withColumn("step", F.col("place")["step"]).drop("place")


def islands(rows: DataFrame, groups: list[str], position: str, *order: str) -> DataFrame:
    """``rows`` with island: a number from 1 within each group that rises where the position isn't the previous plus one.

    A null position always begins an island.
    """
    by = Window.partitionBy(*groups).orderBy(position, *order)
    starts = F.coalesce(F.col(position) != F.lag(position).over(by) + 1, F.lit(True))
    return rows.withColumn("starts_", starts.cast("int")).withColumn("island", F.sum("starts_").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("starts_")


def merge_runs(rows: DataFrame, groups: list[str], position: str, text: str) -> DataFrame:
    """(groups..., first, last, rows, text): each island as one row, its texts joined and white space collapsed."""
    marked = islands(rows, groups, position, text)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(position, text))), lambda s: s[text])
    out = marked.groupBy(*groups, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("rows"), texts.alias("texts"))
    return out.select(*groups, "first", "last", "rows", collapse(F.array_join("texts", " ")).alias("text"))


def merge_in_order(rows: DataFrame, within: str, order: str, position: str, keys: list[str], text: str) -> DataFrame:
    """Neighbouring rows of an ordered list merged while their keys stay and positions run on.

    Differs from ``merge_runs`` in that the list's own order counts. Result: (within, ord, keys..., first, last, text).
    """
    by = Window.partitionBy(within).orderBy(order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(by))
    goes_on = same & F.coalesce(F.col(position) == F.lag(position).over(by) + 1, F.lit(False)) & (F.row_number().over(by) > 1)
    marked = rows.withColumn("starts_", (~goes_on).cast("int")).withColumn("run_", F.sum("starts_").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text])
    out = marked.groupBy(within, "run_", *keys).agg(F.min(order).alias("ord"), F.min(position).alias("first"), F.max(position).alias("last"), texts.alias("texts"))
    return out.select(within, "ord", *keys, "first", "last", collapse(F.array_join("texts", " ")).alias("text"))


def prefix_budget(rows: DataFrame, within: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """The rows of each group that fit a token budget: the first always, then while the running sum stays within it.

    Adds tokens and used, the running sum. A null or blank text needs no tokens. The group's rows are cut into ranges
    of the first order column; the ranges' sums tell where the budget ends, and only ranges that begin within it are
    sorted, each by itself, so a group with a third of all rows costs no more than its part that fits.
    """
    sized = rows.withColumn("tokens", F.coalesce(token_estimate(F.col(text)), F.lit(0)))
    sized = sized.withColumn("part_", range_part(rows, order[0]))
    sums = sized.groupBy(*within, "part_").agg(F.sum("tokens").alias("sum_"))
    upto = Window.partitionBy(*within).orderBy(F.col("part_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("before_", F.coalesce(F.sum("sum_").over(upto), F.lit(0))).withColumn("head_", F.row_number().over(Window.partitionBy(*within).orderBy(F.col("part_").asc_nulls_first())) == 1)
    begins = begins.filter(F.col("before_") <= budget).drop("sum_")
    same = F.lit(True)
    for c in [*within, "part_"]:
        same = same & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    near = sized.join(begins.select(*[F.col(c).alias(f"o_{c}") for c in [*within, "part_"]], "before_", "head_"), same)
    by = Window.partitionBy(*within, "part_").orderBy(*order)
    run = near.withColumn("used", F.col("before_") + F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place_", F.row_number().over(by))
    first = F.col("head_") & (F.col("place_") == 1)
    return run.filter((F.col("used") <= budget) | first).drop("part_", "place_", "before_", "head_", *[f"o_{c}" for c in [*within, "part_"]])


def numbered_within(rows: DataFrame, groups: list[str], *order: str) -> DataFrame:
    """``rows`` with at, the place within the group from 1."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))


def marked_places(rows: DataFrame, groups: list[str], order: str, mark: Column) -> DataFrame:
    """(groups..., places): the places, from 1 within the group, of the rows that carry a mark."""
    placed = numbered_within(rows, groups, order).filter(mark)
    return placed.groupBy(*groups).agg(F.array_sort(F.collect_list("at")).alias("places"))


def interleave(sources: list[DataFrame], within: str, item: str, order: str, limit: int | None = None) -> DataFrame:
    """Lists after each other, each item (without regard to case) at its first place, the first ``limit`` per group."""
    rows = None
    for i, source in enumerate(sources):
        part = source.select(within, item, F.col(order).alias("ord_")).withColumn("list_", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    once = first_wins(rows, [F.upper(F.col(item).cast("string"))], "list_", "ord_", within=[within])
    out = once.withColumn("place", F.row_number().over(Window.partitionBy(within).orderBy("list_", "ord_")))
    out = out.select(within, item, "place")
    return out if limit is None else out.filter(F.col("place") <= limit)


def merge_texts(texts: Column) -> Column:
    """Layer texts folded together: one that contains the other replaces it, else they are joined by a line break."""

    def step(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (a == "") | F.contains(b, a), b).when(b.isNull() | (b == "") | F.contains(a, b), a).otherwise(F.concat_ws("\n", a, b))

    return F.aggregate(texts, F.lit(None).cast("string"), step)


def _overlap(a: list, b: list) -> float:
    most = max(len(set(a)), len(set(b)))
    return len(set(a) & set(b)) / most if most else 0.0


def merge_overlapping(rows: DataFrame, within: str, order: str, members: str, score: str, overlap: float = MERGE_OVERLAP) -> DataFrame:
    """Passages of each group merged greedily in order: one that overlaps a kept one by more than the share joins it.

    The longer passage stays and the higher score wins. Result: (within, members, score, rank), by score. Groups are
    the few passages of one question or chapter; an order-dependent fold has no relational form.
    """
    kind = dict(rows.dtypes)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for ids, value in part.sort_values(order, kind="stable")[[members, score]].itertuples(index=False):
            ids = list(ids) if ids is not None else []
            for k in kept:
                if _overlap(k[0], ids) > overlap:
                    k[0] = ids if len(ids) > len(k[0]) else k[0]
                    k[1] = max(k[1], value)
                    break
            else:
                kept.append([ids, value])
        kept.sort(key=lambda k: -k[1])
        return pd.DataFrame({within: [part[within].iloc[0]] * len(kept), members: [k[0] for k in kept], score: [k[1] for k in kept], "rank": range(1, len(kept) + 1)})

    return rows.groupBy(within).applyInPandas(fold, f"{within} {kind[within]}, {members} {kind[members]}, {score} {kind[score]}, rank int")


def merge_windows(rows: DataFrame, groups: list[str], order: str, anchor: str, members: str, overlap: float = MERGE_OVERLAP) -> DataFrame:
    """Passage windows of each group merged while they overlap enough and one contains the other's anchor.

    Result: (groups..., members) of the merged windows, members in order of appearance.
    """
    kind = dict(rows.dtypes)

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[list] = []
        for who, ids in part.sort_values(order, kind="stable")[[anchor, members]].itertuples(index=False):
            ids = list(ids) if ids is not None else []
            for k in kept:
                if _overlap(k[1], ids) > overlap and (who in k[1] or k[0] in ids):
                    k[1] = list(dict.fromkeys([*k[1], *ids]))
                    break
            else:
                kept.append([who, ids])
        out = pd.DataFrame({members: [k[1] for k in kept]})
        for i, g in enumerate(groups):
            out.insert(i, g, part[g].iloc[0])
        return out

    return rows.groupBy(*groups).applyInPandas(fold, ", ".join(f"{c} {kind[c]}" for c in [*groups, members]))
