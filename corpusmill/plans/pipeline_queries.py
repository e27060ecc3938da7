"""The whole retrieval plan over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import answers as an
from corpusmill.functions import refs
from corpusmill.operators.rules import rules_hit, tag_rows
from corpusmill.plans.data_queries import BSB, TAGS
from corpusmill.plans.fallback import fallback_retrieve
from corpusmill.plans.pipeline import Corpus, cluster_signal, link_signal, retrieve, topic_signal, verse_corpus
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval_queries import kept_index
from corpusmill.session import cut_lineage

ASKED = [
    (1, "What does the Bible say about the covenant of the king?"), (2, "Explain Genesis 1:4"), (3, "MAT 1:5"), (4, "went up to and measured the bread"), (5, "shepherd and flock"),
    (6, "psa 1:3-5"), (7, "who hath not spoken to the men of judgment"), (8, "in the days of"),
]


GUARDS = [(1, ["covenant"], ["GEN 1:1", "GEN 1:2"], ["river"]), (2, ["shepherd", "flock"], ["PSA 1:1"], []), (3, ["bread"], ["GEN 1:3", "MAT 1:4"], ["king"])]
LISTS = [(1, ["judgment"], ["GEN 1:5", "GEN 1:6"], "prepend"), (2, ["night", "stone"], ["GEN 1:1"], "replace")]
PRIORITIES = [(1, ["covenant", "promise"], ["GEN 1:1"]), (2, ["bread"], ["GEN 1:2"]), (3, ["vine", "night"], ["GEN 1:3", "GEN 1:4"])]


def _questions(t):
    """Literal questions, and one about the label of every cluster."""
    asked = t.spark.createDataFrame([(f"q{i}", text) for i, text in ASKED], "query_id string, text string")
    return asked.unionByName(t("tsk_clusters").select(F.col("cluster_id").alias("query_id"), F.concat(F.lit("What does the Bible say about "), "cluster_label", F.lit("?")).alias("text")))


def _corpus(t) -> Corpus:
    verses = cut_lineage(verse_corpus(t("verses"), "BSB"))
    s, d = F.col("source"), F.col("target")
    links = t("cross_references").filter(s.isNotNull() & d.isNotNull()).select(refs.verse_id(s["book"], s["chapter"], s["verse"]).alias("source"), refs.verse_id(d["book"], d["chapter"], d["verse"]).alias("target"), "votes")
    rules = t.spark.createDataFrame(TAGS, "topic_id string, keyword string, confidence double")
    topics = rules.groupBy("topic_id").agg(F.sort_array(F.collect_set("keyword")).alias("words"))
    clusters = t("tsk_clusters").select("cluster_id", F.col("cluster_label").alias("label"), F.col("member_verse_ids").alias("members"), F.col("vote_total").alias("votes"))
    signals = {"topic": topic_signal(tag_rows(verses, rules, "doc_id", "text").select("doc_id", "topic_id", "confidence"), topics), "cluster": cluster_signal(clusters), "crossref": link_signal(links)}
    others = verse_corpus(t("verses"), "KJV").select("book", "chapter", "verse", "text", "translation")
    guards = t.spark.createDataFrame(GUARDS, "rule int, keywords array<string>, items array<string>, excludes array<string>")
    lists = t.spark.createDataFrame(LISTS, "rule int, keywords array<string>, items array<string>, mode string")
    return Corpus(verses, kept_index(t, "verses", verses.select("doc_id", "text"), "doc_id", "text"), links, signals, others, guards, lists)


def _retrieved(t):
    return retrieve(_questions(t), _corpus(t), budget=1500)


@query()
def q_retrieve(t):
    """Every question through all stages: search, signals, guards, lists, neighbours, links, another translation, budget."""
    return _retrieved(t)


@query(
    f"""WITH {BSB}, v AS (SELECT book || ' ' || chapter || ':' || verse AS id, text FROM bsb), asked AS (SELECT cluster_id AS query_id, lower(cluster_label) AS text FROM tsk_clusters),
    p(rule, keywords, items) AS (VALUES {", ".join(f"({r}, {k}, {i})" for r, k, i in PRIORITIES)}), pr AS (SELECT query_id, rule, items FROM asked, p WHERE len([k FOR k IN keywords IF contains(text, k)]) > 0),
    x AS (SELECT query_id, unnest(items) AS item, rule, unnest(range(len(items))) AS pos FROM pr) SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY min(struct_pack(r := rule, a := pos)))::INT AS place FROM x JOIN v ON v.id = item GROUP BY 1, 2"""
)
def j23_fallback_rules(t):
    """The part of the fallback plan that rules decide; the lexical part is tested on a small corpus."""
    rules = t.spark.createDataFrame(PRIORITIES, "rule int, keywords array<string>, items array<string>")
    asked = t("tsk_clusters").select(F.col("cluster_id").alias("query_id"), F.col("cluster_label").alias("text"))
    corpus = _corpus(t)
    found = fallback_retrieve(asked, Corpus(corpus.verses, corpus.index), None, rules)
    ruled = rules_hit(asked, rules).select("query_id", F.explode("items").alias("item")).distinct()
    return found.join(ruled, ["query_id", "item"], "left_semi")


@query()
def j23_fallback(t):
    """The fallback plan with priorities, references, lexical search, guards and lists."""
    rules = t.spark.createDataFrame(PRIORITIES, "rule int, keywords array<string>, items array<string>")
    return fallback_retrieve(_questions(t), _corpus(t), rules, rules.withColumn("rule", -F.col("rule")))


@query()
def f39_prompts(t):
    """The retrieved verses of every question as the context of a prompt, read back again."""
    rows = _retrieved(t)
    line = an.render_verse(F.col("reference"), F.lit("BSB"), F.col("text"), F.lit(None).cast("array<struct<word:string,strongs:string,gloss:string,morph:string,transliteration:string>>"))
    prompts = rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "").alias("prompt"))
    return prompts.select("query_id", F.length("prompt").alias("chars"), F.size(an.prompt_verses(F.col("prompt"))).alias("verses"))
