"""Why an item was chosen: traces of the decisions of every stage, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stages that always leave a trace, and what it says if they did nothing.
STAGES = ("topic_guard", "curation")
UNCHANGED, NOT_INVOKED = "unchanged", "not_invoked"
OUTSIDE, WITHOUT = "selected_outside_hybrid_ranked_candidates", "selected_without_hybrid_candidates"


def decision_traces(items: DataFrame, traces: DataFrame, ran: DataFrame) -> DataFrame:
    """(query_id, item, traces): what the stages said of each item, in order, and a mark for each stage that said nothing.

    ``items`` has (query_id, item), ``traces`` (query_id, item, ord, trace) with traces as ``stage:what``, ``ran``
    (query_id, stage) names the stages that ran for a question: a stage without a trace left the item unchanged if it
    ran, else it wasn't invoked.
    """
    said = traces.groupBy("query_id", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "trace"))), lambda t: t["trace"]).alias("said"))
    stages = ran.groupBy("query_id").agg(F.collect_set("stage").alias("ran"))
    rows = items.join(said, ["query_id", "item"], "left").join(stages, "query_id", "left")
    none = F.array().cast("array<string>")
    known, active = F.coalesce("said", none), F.coalesce("ran", none)

    def mark(stage: str) -> Column:
        silent = ~F.exists(known, lambda trace: F.startswith(trace, F.lit(f"{stage}:")))
        return F.when(silent, F.when(F.array_contains(active, stage), f"{stage}:{UNCHANGED}").otherwise(f"{stage}:{NOT_INVOKED}"))

    return rows.select("query_id", "item", F.concat(known, F.array_compact(F.array(*map(mark, STAGES)))).alias("traces"))


def selection_traces(traced: DataFrame, ranks: DataFrame) -> DataFrame:
    """``decision_traces`` headed by where the item came from: its final rank, outside the ranked ones, or without any.

    ``ranks`` has (query_id, item, rank); a null rank is none.
    """
    placed = ranks.filter("rank is not null")
    rows = traced.join(placed.select("query_id", "item", "rank"), ["query_id", "item"], "left").join(placed.select("query_id").distinct().withColumn("some_", F.lit(True)), "query_id", "left")
    head = F.when(F.col("rank").isNotNull(), F.concat(F.lit("hybrid_final_rank:"), F.col("rank").cast("string"))).when(F.coalesce("some_", F.lit(False)), OUTSIDE).otherwise(WITHOUT)
    return rows.select("query_id", "item", F.concat(F.array(head), F.col("traces")).alias("traces"))
