"""The whole retrieval plan for many questions at once: understand, search, rerank, expand, guard, enrich, merge.

Every stage is a DataFrame keyed by query_id; nothing is collected, so one question and a million share a plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.questions import add_synonyms, understand
from corpusmill.functions.refs import parse_verse, reference_ids, references_in, verse_id
from corpusmill.functions.text import fallback_tokens
from corpusmill.operators.fusion import clamp_top_k, min_max, rerank
from corpusmill.operators.graph import cluster_boost, expand_links
from corpusmill.operators.lexical import CANDIDATES, Index, search
from corpusmill.operators.lookup import override, unique_rows
from corpusmill.operators.rules import curated, detect_topics, guard
from corpusmill.operators.sequence import first_wins, interleave, merge_in_order, prefix_budget
from corpusmill.session import cut_lineage


#: A signal made for a search: from questions (query_id, text), candidates (query_id, doc_id, ...) and direct references.
Signal = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass
class Corpus:
    """Verses (doc_id, book, chapter, verse, text, translation), one row per doc_id; and what refers to them."""

    verses: DataFrame
    index: Index
    links: DataFrame | None = None  # source, target, votes
    signals: dict[str, DataFrame | Signal] | None = None
    translations: DataFrame | None = None  # book, chapter, verse, text, translation
    guards: DataFrame | None = None
    lists: DataFrame | None = None


def verse_corpus(rows: DataFrame, translation: str) -> DataFrame:
    """One row per verse of a translation: the latest load, of equals the smallest row id; empty texts left out."""
    own = rows.withColumn("translation", F.upper(F.trim("translation"))).filter((F.col("translation") == translation) & (F.length(F.trim("text")) > 0))
    own = own.withColumn("book", F.upper(F.trim("book"))).withColumn("doc_id", verse_id(F.col("book"), F.col("chapter"), F.col("verse"))).filter("doc_id is not null")
    latest = unique_rows(own, ["doc_id"], F.col("loaded_at").desc_nulls_last(), F.col("row_id"))
    return latest.select("doc_id", "book", "chapter", "verse", "text", "translation")


def retrieve(questions: DataFrame, corpus: Corpus, top_k: int | None = None, reach: int = 1, budget: int | None = None) -> DataFrame:
    """(query_id, place, reference, book, chapter, first, last, text, related) for every question (query_id, text).

    Questions that are direct references skip the search. Others are searched with synonyms, reranked, and direct
    references come first; the best are widened by their neighbours. Cross-references are added for explanations and
    marked related. Guards and curated lists apply where given, then neighbouring verses are merged.
    """
    k = clamp_top_k(top_k)
    asked = cut_lineage(understand(questions, "text"))  # questions are understood once, however many stages read them
    questions = asked.select(*questions.columns)
    direct = asked.select("query_id", "intent", F.posexplode(reference_ids(references_in(F.col("normalized")))).alias("ord", "doc_id"))
    known = corpus.verses.select("doc_id")
    direct = direct.join(known, "doc_id", "left_semi")
    topical = asked.filter("intent <> 'DIRECT_REFERENCE'").withColumn("search", add_synonyms(F.col("expanded"), F.size("negations") > 0, 2))
    found = min_max(search(corpus.index, topical.select("query_id", "search"), "query_id", "search", CANDIDATES, corpus.verses)).select("query_id", "doc_id", F.col("norm").alias("score"), "rank")
    found, direct = cut_lineage(found), cut_lineage(direct)  # a few rows per question, read by every signal
    made = {n: s if isinstance(s, DataFrame) else s(questions, found, direct) for n, s in (corpus.signals or {}).items()}
    signals = made | {"direct": direct.select("query_id", "doc_id", F.lit(1.0).alias("value"))}
    best = rerank(found, signals, CANDIDATES)
    listed = cut_lineage(interleave([direct.select("query_id", "doc_id", "ord"), best.select("query_id", "doc_id", F.col("rank").alias("ord"))], "query_id", "doc_id", "ord", k))  # k rows per question
    texts = corpus.verses.select("doc_id", "text")
    if corpus.guards is not None:
        listed = guard(questions, listed.join(texts, "doc_id").select("query_id", F.col("doc_id").alias("item"), "place", "text"), corpus.guards).withColumnRenamed("item", "doc_id")
    if corpus.lists is not None:
        listed = curated(questions, listed.withColumnRenamed("doc_id", "item"), corpus.lists).withColumnRenamed("item", "doc_id")
    if corpus.guards is not None or corpus.lists is not None:
        listed = cut_lineage(listed)  # read by the neighbours and the links
    at = parse_verse(F.col("doc_id"))
    keys = listed.join(asked.select("query_id", "intent"), "query_id").withColumn("p", at)
    width = F.when((F.col("place") <= 3) & (F.col("intent") == "TOPICAL_QUERY"), reach).otherwise(0)
    around = keys.withColumn("v", F.explode(F.sequence(F.col("p.verse") - width, F.col("p.verse") + width))).filter("v >= 1")
    around = around.select("query_id", (F.col("place") * 1000 + F.col("v") - F.col("p.verse")).alias("ord"), F.lit(False).alias("related"), F.col("p.book").alias("book"), F.col("p.chapter").alias("chapter"), F.col("v").alias("verse"))
    if corpus.links is not None:
        primary = listed.join(asked.filter("intent = 'VERSE_EXPLANATION'"), "query_id", "left_semi")
        more = expand_links(primary.select("query_id", "doc_id"), corpus.links, "query_id", "doc_id", "source", "target", "votes")
        more = more.withColumn("p", parse_verse(F.col("target"))).filter("p is not null")
        around = around.unionByName(more.select("query_id", (F.lit(1_000_000) + F.col("place")).alias("ord"), F.lit(True).alias("related"), F.col("p.book").alias("book"), F.col("p.chapter").alias("chapter"), F.col("p.verse").alias("verse")))
    rows = around.join(corpus.verses.select("book", "chapter", "verse", "text", "translation"), ["book", "chapter", "verse"])
    if corpus.translations is not None:
        rows = override(rows, corpus.translations, ["book", "chapter", "verse"], ["text", "translation"])
    once = first_wins(rows, ["book", "chapter", "verse"], "ord", within=["query_id"])
    merged = merge_in_order(once, "query_id", "ord", "verse", ["book", "chapter", "translation", "related"], "text")
    span = F.when(F.col("first") == F.col("last"), F.lit("")).otherwise(F.concat(F.lit("-"), F.col("last").cast("string")))
    out = merged.withColumn("reference", F.concat("book", F.lit(" "), F.col("chapter").cast("string"), F.lit(":"), F.col("first").cast("string"), span))
    if budget is not None:
        out = prefix_budget(cut_lineage(out), ["query_id"], ["ord"], "text", budget)
    return out.select("query_id", "ord", "reference", "book", "chapter", "first", "last", "text", "related")


def topic_signal(verse_topics: DataFrame, topics: DataFrame) -> Signal:
    """Candidates that share a topic with the question, with its confidence: made from the candidates alone.

    ``verse_topics`` has (doc_id, topic_id, confidence), ``topics`` (topic_id, words).
    """

    def make(questions: DataFrame, candidates: DataFrame, direct: DataFrame) -> DataFrame:
        asked = detect_topics(questions, topics).select("query_id", "topic_id")
        met = candidates.select("query_id", "doc_id").join(verse_topics, "doc_id").join(asked, ["query_id", "topic_id"], "left_semi")
        return met.select("query_id", "doc_id", F.col("confidence").alias("value"))

    return make


def cluster_signal(clusters: DataFrame, most: int = 8) -> Signal:
    """Members of the clusters, by votes, of whose label the question has a word.

    ``clusters`` has (cluster_id, label, members, votes).
    """

    def make(questions: DataFrame, candidates: DataFrame, direct: DataFrame) -> DataFrame:
        words = questions.select("query_id", F.explode(F.array_distinct(fallback_tokens(F.col("text")))).alias("word"))
        labels = clusters.select("cluster_id", F.explode(F.array_distinct(fallback_tokens(F.col("label")))).alias("word"))
        met = words.join(labels, "word").select("query_id", "cluster_id").distinct().join(clusters.select("cluster_id", "votes"), "cluster_id")
        by = Window.partitionBy("query_id").orderBy(F.col("votes").desc_nulls_last(), "cluster_id")
        top = met.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most).join(clusters.select("cluster_id", "members"), "cluster_id")
        boost = cluster_boost(top, "members", "votes", "rank", "query_id")
        return boost.select("query_id", F.col("item").alias("doc_id"), F.col("signal").alias("value"))

    return make


def link_signal(links: DataFrame) -> Signal:
    """The strongest cross-references of the verses that the question names."""

    def make(questions: DataFrame, candidates: DataFrame, direct: DataFrame) -> DataFrame:
        more = expand_links(direct.select("query_id", "doc_id"), links, "query_id", "doc_id", "source", "target", "votes")
        return more.select("query_id", F.col("target").alias("doc_id"), F.lit(1.0).alias("value"))

    return make
