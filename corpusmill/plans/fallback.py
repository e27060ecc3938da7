"""Retrieval from rules, references and lexical search alone, for questions that the main plan has nothing for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.refs import reference_ids, references_in
from corpusmill.operators.fusion import CANDIDATES
from corpusmill.operators.lexical import search
from corpusmill.operators.rules import curated, guard, rules_hit
from corpusmill.plans.pipeline import Corpus
from corpusmill.session import cut_lineage

#: Below so many items found by rules and references the lexical search adds its own.
ENOUGH = 2


def fallback_retrieve(questions: DataFrame, corpus: Corpus, lists: DataFrame | None = None, priorities: DataFrame | None = None) -> DataFrame:
    """(query_id, item, place) for every question (query_id, text), items being doc_ids of the corpus.

    Items of matching ``lists`` stand first, then those of matching ``priorities`` (both (rule, keywords, items), a rule
    matching a question that contains any keyword), then verses that the question names; each item once, at its first
    place. Questions with fewer than ``ENOUGH`` of these get the best of the lexical search after them. The corpus's
    guards and curated lists are applied to the result. Items that the corpus lacks are dropped.
    """
    questions = cut_lineage(questions)  # read by every rule
    parts = []
    for number, rules in enumerate((lists, priorities)):
        if rules is not None:
            hit = rules_hit(questions, rules).select("query_id", "rule", F.posexplode("items").alias("at", "item"))
            parts.append(hit.select("query_id", "item", F.lit(number).alias("list"), "rule", "at"))
    named = questions.select("query_id", F.posexplode(reference_ids(references_in(F.col("text")))).alias("at", "item"))
    parts.append(named.select("query_id", "item", F.lit(2).alias("list"), F.lit(0).alias("rule"), "at"))
    first = parts[0]
    for part in parts[1:]:
        first = first.unionByName(part)
    known = corpus.verses.select(F.col("doc_id").alias("item"))
    first = cut_lineage(first.join(known, "item", "left_semi").select("query_id", "item", "list", "rule", "at"))  # a few rows per question
    enough = first.groupBy("query_id").agg(F.countDistinct("item").alias("n")).filter(F.col("n") >= ENOUGH)
    few = questions.join(enough, "query_id", "left_anti")
    found = search(corpus.index, few, "query_id", "text", CANDIDATES, corpus.verses)
    rows = first.unionByName(found.select("query_id", F.col("doc_id").alias("item"), F.lit(3).alias("list"), F.lit(0).alias("rule"), F.col("rank").alias("at")))
    once = rows.groupBy("query_id", "item").agg(F.min(F.struct("list", "rule", "at")).alias("first_"))
    listed = once.select("query_id", "item", F.row_number().over(Window.partitionBy("query_id").orderBy("first_", "item")).alias("place"))
    if corpus.guards is not None or corpus.lists is not None:
        listed = cut_lineage(listed)  # a few rows per question, read by the guards and the lists
    if corpus.guards is not None:
        texts = corpus.verses.select(F.col("doc_id").alias("item"), "text")
        listed = guard(questions, listed.join(texts, "item").select("query_id", "item", "place", "text"), corpus.guards)
    return curated(questions, listed, corpus.lists) if corpus.lists is not None else listed
