"""Score normalisation, gating, rank fusion, reranking and diagnostics of ranked lists.

Ranked lists are (query_id, doc_id, score, rank) for any number of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clamp01, dot
from corpusmill.operators.lexical import CANDIDATES, Index, ranked, search
from corpusmill.session import cut_lineage

RRF_K = 60
#: The semantic step runs for questions of at least so many words whose first score leads the fifth by less than this.
GATE_WORDS, GATE_LEAD, GATE_PLACE = 4, 0.15, 5
# Weights of the signals in the reranker.
WEIGHTS = {"direct": 0.15, "metadata": 0.10, "topic": 0.10, "passage": 0.08, "cluster": 0.06, "crossref": 0.05}
TOP_K_RANGE, TOP_K_DEFAULT = (5, 8), 5
LOW_CONFIDENCE = 0.75
# Limits below which a search is widened.
WIDEN_COUNT, WIDEN_COVERAGE, WIDEN_CONFIDENCE = 4, 0.6, 0.75


def clamp_top_k(k: float | None) -> int:
    """The number of results: floored, 5 by default, between 5 and 8."""
    low, high = TOP_K_RANGE
    return TOP_K_DEFAULT if k is None else max(low, min(high, int(k // 1)))


def min_max(rows: DataFrame, score: str = "score", out: str = "norm", partition: str = "query_id") -> DataFrame:
    """Scores scaled to 0..1 within each question; all 1 where they are equal."""
    own = Window.partitionBy(partition)
    low, high = F.min(score).over(own), F.max(score).over(own)
    return rows.withColumn(out, F.when(high == low, 1.0).otherwise((F.col(score) - low) / F.nullif(high - low, F.lit(0.0))))


def gate(rows: DataFrame, questions: DataFrame, query_id: str, text: str, embedding: str | None = None) -> DataFrame:
    """(query_id, lead, open): whether the semantic step is worth while, by the lead of the first normalised score."""
    norm = min_max(rows)
    last = F.max(F.when(F.col("rank") <= GATE_PLACE, F.struct("rank", "norm")))["norm"]
    lead = norm.groupBy("query_id").agg((F.max(F.when(F.col("rank") == 1, F.col("norm"))) - last).alias("lead"))
    words = F.size(F.filter(F.split(F.trim(F.col(text)), r"\s+"), lambda w: w != ""))
    asked = questions.select(F.col(query_id).alias("query_id"), words.alias("words"), (F.col(embedding).isNotNull() if embedding else F.lit(True)).alias("has_vector"))
    return lead.join(asked, "query_id").select("query_id", "lead", ((F.col("words") >= GATE_WORDS) & F.col("has_vector") & (F.col("lead") < GATE_LEAD)).alias("open"))


def semantic_rank(rows: DataFrame, questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rows`` with similarity and rank_sem: dot products, documents without a vector last in their lexical order.

    ``questions`` has (query_id, query_vector), ``vectors`` has (doc_id, doc_vector).
    """
    near = rows.join(questions, "query_id").join(vectors, "doc_id", "left").withColumn("similarity", dot(F.col("query_vector"), F.col("doc_vector")))
    by = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), F.col("rank"))
    return near.withColumn("rank_sem", F.row_number().over(by)).drop("query_vector", "doc_vector")


def rrf(rank_lexical: Column, rank_semantic: Column, k: int = RRF_K) -> Column:
    """Reciprocal-rank fusion; a missing semantic rank adds nothing."""
    return 1.0 / (k + rank_lexical) + F.coalesce(1.0 / (k + rank_semantic), F.lit(0.0))


def hybrid_search(index: Index, docs: DataFrame, vectors: DataFrame, questions: DataFrame, query_id: str, text: str, vector: str, top_k: int | None = None, doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): lexical candidates, and for gated questions their fusion with vector ranks.

    Questions whose gate is closed keep the normalised lexical score; only the candidates of open ones meet a vector.
    """
    k = clamp_top_k(top_k)
    first = cut_lineage(search(index, questions, query_id, text, CANDIDATES, docs, doc_id, doc_text))  # a few rows per question, read by the gate and both branches
    norm = min_max(first)
    opened = gate(first, questions, query_id, text, vector).filter("open").select("query_id")
    asked = questions.select(F.col(query_id).alias("query_id"), F.col(vector).alias("query_vector"))
    near = semantic_rank(norm.join(opened, "query_id", "left_semi"), asked, vectors)
    fused = near.select("query_id", "doc_id", rrf(F.col("rank"), F.col("rank_sem")).alias("score"), F.col("rank").alias("before"))
    plain = norm.join(opened, "query_id", "left_anti").select("query_id", "doc_id", F.col("norm").alias("score"), F.col("rank").alias("before"))
    return ranked(fused.unionByName(plain), k, F.col("before")).select("query_id", "doc_id", "score", "rank")


def rerank(candidates: DataFrame, signals: dict[str, DataFrame], limit: int, weights: dict[str, float] | None = None) -> DataFrame:
    """Candidates reordered by a weighted sum of their score and further signals.

    ``signals`` maps a name of ``weights`` to (query_id, doc_id, value), or (doc_id, value) for signals that don't
    depend on the question. A missing signal is 0, for metadata 0.5. A null score counts by place, (n - i) / n with i
    from 0.
    """
    weights = WEIGHTS if weights is None else weights
    count = F.count("*").over(Window.partitionBy("query_id"))
    rows = candidates.withColumn("base", F.coalesce("score", (count - F.col("rank") + 1) / count))
    total = F.col("base")
    for name, weight in weights.items():
        if name not in signals:
            total = total + (weight * 0.5 if name == "metadata" else 0.0)
            continue
        keys = [c for c in ("query_id", "doc_id") if c in signals[name].columns]
        rows = rows.join(signals[name].groupBy(*keys).agg(F.max("value").alias(f"signal_{name}")), keys, "left")
        total = total + weight * F.coalesce(clamp01_or_null(F.col(f"signal_{name}")), F.lit(0.5 if name == "metadata" else 0.0))
    rows = rows.withColumn("score", total)
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("rank"))
    return rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= limit).select("query_id", "doc_id", "score", "rank")


def clamp01_or_null(value: Column) -> Column:
    """``clamp01`` that leaves null alone."""
    return F.when(value.isNotNull(), clamp01(value))


def diagnostics(rows: DataFrame) -> DataFrame:
    """(query_id, n, top1, lead5, entropy): confidence of each ranked list, six digits.

    ``entropy`` is Shannon's, over the positive scores' shares and relative to its maximum; 0 for one result or a
    non-positive sum.
    """
    own = Window.partitionBy("query_id")
    shares = rows.withColumn("total", F.sum("score").over(own)).withColumn("count", F.count("*").over(own))
    p = F.when((F.col("total") > 0) & (F.col("score") > 0), F.col("score") / F.col("total"))
    last = F.max(F.when(F.col("rank") <= GATE_PLACE, F.struct("rank", "score")))["score"]
    out = shares.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top1"), last.alias("fifth"), F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)).alias("bits")
    )
    entropy = F.when(F.col("n") > 1, F.col("bits") / F.log2(F.greatest(F.col("n"), F.lit(2)))).otherwise(0.0)
    return out.select("query_id", "n", F.round("top1", 6).alias("top1"), F.round(F.col("top1") - F.col("fifth"), 6).alias("lead5"), F.round(entropy, 6).alias("entropy"))


def low_confidence(rows: DataFrame, questions: DataFrame, query_id: str, top_k: int = TOP_K_DEFAULT) -> DataFrame:
    """(query_id, low): whether the mean of the best scores is low; true for a question without results."""
    means = rows.filter(F.col("rank") <= min(top_k, 5)).groupBy("query_id").agg(F.avg("score").alias("mean"))
    asked = questions.select(F.col(query_id).alias("query_id")).distinct()
    return asked.join(means, "query_id", "left").select("query_id", (F.coalesce("mean", F.lit(0.0)) < LOW_CONFIDENCE).alias("low"))


def widen_decision(count: Column, covered: Column) -> Column:
    """struct<confidence, widen, reasons> from the number of results and the share of question words they cover."""
    confidence = (F.least(count / WIDEN_COUNT, F.lit(1.0)) + covered) / 2
    reasons = F.array_compact(F.array(F.when(count < WIDEN_COUNT, "few results"), F.when(covered < WIDEN_COVERAGE, "low coverage"), F.when(confidence < WIDEN_CONFIDENCE, "low confidence")))
    return F.struct(F.round(confidence, 6).alias("confidence"), (F.size(reasons) > 0).alias("widen"), reasons.alias("reasons"))
