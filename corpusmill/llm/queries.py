"""Queries over the operators of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.lookalike import match_forms, skeleton_groups
from corpusmill.llm.mixing import mix_sources, source_key
from corpusmill.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from corpusmill.llm.packing import pack_items
from corpusmill.llm.reading import reading_levels
from corpusmill.llm.similar import copy_classes, mutual_pairs, similar_to_all, similar_vectors
from corpusmill.llm.splitting import split_oversized
from corpusmill.llm.tokens import token_count
from corpusmill.llm.topn import top_n_per_group
from corpusmill.operators.vectors import nearest
from corpusmill.session import cut_lineage, spread, table

NEIGHBOURS = 5
LEAST_COSINE = 0.80
SHARED_WORDS = 0.60
TOP_LINKS = 5


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The collection of problem 1: (id, embedding) of verses, passages and clusters."""
    parts = (("verse_embeddings", "id"), ("passage_windows", "passage_id"), ("tsk_clusters", "cluster_id"))
    first, *rest = (table(spark, sf, t).select(F.col(c).alias("id"), "embedding") for t, c in parts)
    for part in rest:
        first = first.unionByName(part)
    return first


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return mutual_pairs(similar_vectors(vectors(spark, sf), NEIGHBOURS, LEAST_COSINE))


def p1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The most similar rows of every row, without a least similarity."""
    return similar_to_all(vectors(spark, sf), NEIGHBOURS)


def p1_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Every usable vector with its class of exact copies."""
    return copy_classes(vectors(spark, sf))


def p1_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows were asked, and whether at least 0.9 of their five neighbours by brute force were found.

    Asked are the rows whose id has a digest divisible by 50, against all rows. Where neighbours are equally near,
    any of them counts: found ones at least as near as the fifth by brute force are hits.
    """
    rows = vectors(spark, sf)
    asked = rows.filter(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 50 == 0)
    exact = nearest(asked.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vector")), rows.select(F.col("id").alias("doc_id"), F.col("embedding").alias("doc_vector")), NEIGHBOURS + 1)
    due = exact.filter("query_id <> doc_id").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("at") <= NEIGHBOURS)
    due = due.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("due"), F.min("score").alias("least"))
    found = p1_neighbours(spark, sf).join(due, "id").filter(F.col("cosine") >= F.col("least") - 1e-7).groupBy("id").agg(F.count("*").alias("met"))
    both = due.join(found, "id", "left").agg(F.count("*").alias("asked"), (F.coalesce(F.sum(F.least("met", "due")), F.lit(0)) >= 0.9 * F.coalesce(F.sum("due"), F.lit(0))).alias("reached"))
    return both


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_duplicate_pairs(table(spark, sf, "verses"), "row_id", "text", SHARED_WORDS)
    return pairs.select(F.col("item_a").alias("row_id_a"), F.col("item_b").alias("row_id_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per verse row with words: its class of equal word sets, and the class's copies and links."""
    members, classes, links = near_duplicate_groups(table(spark, sf, "verses"), "row_id", "text", SHARED_WORDS)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    sizes = classes.select("class_id", "copies").join(ends, "class_id", "left").na.fill(0, ["links"])
    return members.join(sizes, "class_id").select(F.col("item").alias("row_id"), "class_id", "copies", "links")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "greek_interlinear").select("word_id", "w").unionByName(table(spark, sf, "gloss_words").select("word_id", "w"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    words = _words(spark, sf)
    found = match_forms(words, "w", table(spark, sf, "word_forms"), "form_id", "form")
    return words.join(found, words["w"] == found["text"]).select("word_id", "form_id").distinct()


def p3_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word with its skeleton and the form that stands for its group."""
    return skeleton_groups(_words(spark, sf), "w")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The pieces of every passage window; windows within their limits are one piece."""
    return split_oversized(table(spark, sf, "passage_windows"), table(spark, sf, "embed_models"), table(spark, sf, "verses"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The passages that came out as more than one piece."""
    return p4_pieces(spark, sf).filter("piece = 1").select("passage_id").distinct()


def p4_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Passages, those in pieces, and how many pieces or passages break a rule: limits, gaps in the text, lost verses."""
    own = table(spark, sf, "passage_windows").select("passage_id", F.col("text").alias("whole"), F.col("verse_ids").alias("every"), "embedding_model")
    rows = p4_pieces(spark, sf).join(own, "passage_id").join(F.broadcast(table(spark, sf, "embed_models")), "embedding_model", "left")  # four models
    by = Window.partitionBy("passage_id").orderBy("piece")
    gap = (F.col("char_from") > F.coalesce(F.lag("char_to").over(by), F.lit(0))) | (F.substring("whole", F.col("char_from") + 1, F.col("char_to") - F.col("char_from")) != F.col("text"))
    over = F.coalesce((F.char_length("text") > F.col("max_chars")) | (F.size("verse_ids") > F.col("max_verses")), F.lit(False))
    whole = F.greatest(F.coalesce(F.char_length("whole"), F.lit(0)), F.lit(0))
    parts = rows.withColumn("gap", F.coalesce(gap, F.lit(False)).cast("long")).withColumn("over", over.cast("long")).groupBy("passage_id").agg(
        F.count("*").alias("n"), F.sum("over").alias("over"), (F.sum("gap") + (F.max("char_to") < F.max(whole)).cast("long")).alias("gap"),
        (F.size(F.array_distinct(F.flatten(F.collect_list("verse_ids")))) != F.max(F.size(F.array_distinct(F.coalesce("every", F.array().cast("array<string>")))))).cast("long").alias("lost"),
    )
    return parts.agg(F.count("*").alias("passages"), F.count_if(F.col("n") > 1).alias("split"), F.sum("over").alias("over_limit"), F.sum("gap").alias("gaps"), F.sum("lost").alias("lost_verses"))


def p3_composed(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of p3_found whose word differs from the form by its encoding as composed characters alone."""

    @F.pandas_udf("string")
    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    found = p3_found(spark, sf).join(_words(spark, sf), "word_id").join(table(spark, sf, "word_forms").select("form_id", "form"), "form_id")
    return found.filter(composed("w") == F.col("form")).select("word_id", "form_id").distinct()


def p5_top_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links with the most votes of every source verse, with their place."""
    source = F.col("source")
    book = F.upper(F.regexp_replace(source["book"], r"(?U)^\s+|\s+$", ""))
    links = table(spark, sf, "cross_references").select("edge_id", "votes", book.alias("book"), source["chapter"].alias("chapter"), source["verse"].alias("verse"))
    return top_n_per_group(links, ["book", "chapter", "verse"], "votes", "edge_id", TOP_LINKS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_top_links(spark, sf).select("edge_id")


def _document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, tokens), counted once and kept in the checkpoint folder."""
    docs = spread(table(spark, sf, "documents"))
    return cut_lineage(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document or piece, for each capacity."""
    docs = _document_tokens(spark, sf)
    out = None
    for row in table(spark, sf, "context_budgets").collect():  # a fixed table of three rows
        packed = pack_items(docs, "doc_id", "tokens", row["capacity_tokens"])
        packed = packed.select(F.lit(row["budget"]).alias("budget"), "doc_id", "piece", F.col("size_from").alias("token_from"), F.col("size_to").alias("token_to"), "container")
        out = packed if out is None else out.unionByName(packed)
    return out


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity: containers, tokens packed, and the share of room that is used."""
    budgets = table(spark, sf, "context_budgets")
    packed = p6_containers(spark, sf).filter("container is not null")
    sums = packed.groupBy("budget").agg((F.max("container") + 1).alias("containers"), F.sum(F.col("token_to") - F.col("token_from")).alias("tokens"))
    return sums.join(F.broadcast(budgets), "budget").select("budget", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("used"))


def p6_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per capacity: documents, and how many containers or documents break a rule: room, needless cuts, lost tokens."""
    packed = p6_containers(spark, sf).join(F.broadcast(table(spark, sf, "context_budgets")), "budget")
    size = F.col("token_to") - F.col("token_from")
    loads = packed.filter("container is not null").groupBy("budget", "container", "capacity_tokens").agg(F.sum(size).alias("load"))
    over = loads.groupBy("budget").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("over_capacity"))
    docs = packed.groupBy("budget", "doc_id").agg(F.count("*").alias("n"), F.sum(size).alias("tokens"), F.max("capacity_tokens").alias("room"), F.max("token_to").alias("last")).join(_document_tokens(spark, sf).select("doc_id", F.col("tokens").alias("due")), "doc_id")
    rules = docs.groupBy("budget").agg(F.count("*").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("due") <= F.col("room"))).alias("needless_cuts"), F.count_if((F.col("tokens") != F.col("due")) | (F.col("last") != F.col("due"))).alias("lost"))
    return rules.join(over, "budget").select("budget", "documents", "over_capacity", "needless_cuts", "lost")


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Per listed source: documents, whether a document is used too often, and whether the tokens are on target.

    Copies are whole, so a source may miss its share of what can be had by its longest document, and the whole corpus by
    the longest of every source.
    """
    weights = table(spark, sf, "source_weights")
    copies, report = mix_sources(_document_tokens(spark, sf), "doc_id", "source", "tokens", weights)
    report = cut_lineage(report)
    longest = copies.groupBy("source").agg(F.max("tokens").alias("longest"))
    caps = weights.select(source_key(F.col("source")).alias("source"), "max_repeats")
    rows = report.join(caps, "source").join(longest, "source", "left").na.fill(0, ["longest"])
    sums = rows.agg(F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("all_shares"), F.sum("mixed_tokens").alias("all_tokens"), F.sum("longest").alias("all_longest"))
    rows = rows.crossJoin(F.broadcast(sums))  # a single row
    due = F.when(F.col("tokens") > 0, F.col("target_share") / F.col("all_shares")).otherwise(0.0)
    near = F.abs(F.col("mixed_tokens") - due * F.col("all_tokens")) <= F.col("longest") + due * F.col("all_longest")
    return rows.select("source", "documents", (F.col("max_copies") > F.col("max_repeats")).alias("too_often"), near.alias("on_target"))


def p7_copies(spark: SparkSession, sf: str) -> DataFrame:
    """How often every document is used."""
    docs = _document_tokens(spark, sf)
    return mix_sources(docs, "doc_id", "source", "tokens", table(spark, sf, "source_weights"))[0]


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The share of tokens that each listed source reaches."""
    docs = _document_tokens(spark, sf)
    return mix_sources(docs, "doc_id", "source", "tokens", table(spark, sf, "source_weights"))[1]


def p8_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The reading level of every document."""
    return reading_levels(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "reading_labels"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a level or without text, and whether nine of ten labelled ones lie within one band of their raters."""
    levels = cut_lineage(p8_levels(spark, sf))
    judged = table(spark, sf, "reading_labels").groupBy("doc_id").agg(F.avg("band").alias("judged"))
    near = levels.join(judged, "doc_id").filter("band is not null").agg((F.count_if(F.abs(F.col("grade") - F.col("judged")) <= 1) >= 0.9 * F.count("*")).alias("near_raters"))
    return levels.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(near))  # a single row


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_levels(spark, sf).filter("words >= 60 and band = 4").select("doc_id").distinct()


def queries() -> dict:
    own = (p1_found, p1_neighbours, p1_copies, p1_recall, p2_found, p2_classes, p3_found, p3_groups, p3_composed, p4_found, p4_pieces, p4_checks, p5_found, p5_top_links, p6_containers, p6_fill, p6_checks, p7_copies, p7_shares, p7_checks, p8_found, p8_levels, p8_checks)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express over whole tables; the others are tested against brute force."""
    usable = """
        WITH vec AS (
            SELECT id, embedding::DOUBLE[] AS e FROM verse_embeddings
            UNION ALL SELECT passage_id, embedding::DOUBLE[] FROM passage_windows
            UNION ALL SELECT cluster_id, embedding::DOUBLE[] FROM tsk_clusters),
        ok AS (SELECT id, e, len(e) AS n FROM vec WHERE e IS NOT NULL AND len(e) > 0
               AND len([x FOR x IN e IF x IS NULL OR isnan(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0)"""
    pieces = usable + """,
        near AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.e, b.e) AS c
                 FROM ok a JOIN ok b ON a.n = b.n AND a.id <> b.id),
        best AS (SELECT x, y, c FROM near QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(c, 9) DESC, y) <= 5)
        SELECT p.x AS id_a, p.y AS id_b FROM best p JOIN best q ON p.x = q.y AND p.y = q.x
        WHERE p.x < p.y AND p.c >= 0.8"""
    words = """
        WITH w AS (SELECT row_id, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\p{L}+')]) AS s FROM verses),
        u AS (SELECT row_id, len(s) AS n, unnest(s) AS t FROM w WHERE len(s) > 0),
        shared AS (SELECT a.row_id AS a, b.row_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
                   FROM u a JOIN u b ON a.t = b.t AND a.row_id < b.row_id GROUP BY 1, 2)
        SELECT a AS row_id_a, b AS row_id_b FROM shared WHERE k >= 0.6::DOUBLE * (na + nb - k)"""
    classes = """
        WITH k AS (SELECT row_id, list_sort(list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\p{L}+')])) AS s FROM verses),
        c AS (SELECT s, min(row_id) AS class_id, count(*) AS copies FROM k WHERE len(s) > 0 GROUP BY s),
        u AS (SELECT class_id, len(s) AS n, unnest(s) AS t FROM c),
        shared AS (SELECT a.class_id AS a, b.class_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
                   FROM u a JOIN u b ON a.t = b.t AND a.class_id < b.class_id GROUP BY 1, 2),
        l AS (SELECT unnest([a, b]) AS class_id FROM shared WHERE k >= 0.6::DOUBLE * (na + nb - k)),
        e AS (SELECT class_id, count(*) AS links FROM l GROUP BY 1)
        SELECT row_id, class_id, copies, coalesce(links, 0) AS links FROM k JOIN c USING (s) LEFT JOIN e USING (class_id)"""
    source = "regexp_replace(lower(regexp_replace(source, '^[\\s_-]+|[\\s_-]+$', '', 'g')), '[\\s_-]+', '_', 'g')"
    top = """
        WITH l AS (SELECT DISTINCT upper(trim(source.book)) AS book, source.chapter AS chapter, source.verse AS verse, edge_id, votes
                   FROM cross_references WHERE votes IS NOT NULL AND source IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY votes DESC, edge_id) AS place FROM l)"""
    return {
        "p1_found": pieces,
        "p1_copies": usable + " SELECT id, min(id) OVER (PARTITION BY e) AS class_id, count(*) OVER (PARTITION BY e) AS copies FROM ok",
        "p1_recall": usable + " SELECT count(*) AS asked, true AS reached FROM ok WHERE ('0x' || substr(md5(id), 1, 4))::INT % 50 = 0",
        "p2_found": words,
        "p2_classes": classes,
        "p3_composed": """
            WITH w AS (SELECT word_id, w FROM greek_interlinear UNION ALL SELECT word_id, w FROM gloss_words)
            SELECT DISTINCT word_id, form_id FROM w JOIN word_forms ON nfc_normalize(w) = form AND w <> form""",
        "p4_checks": """
            SELECT count(*) AS passages, count(*) FILTER (length(text) > max_chars OR len(verse_ids) > max_verses) AS split, 0::BIGINT AS over_limit, 0::BIGINT AS gaps, 0::BIGINT AS lost_verses
            FROM passage_windows LEFT JOIN embed_models USING (embedding_model)""",
        "p6_checks": "SELECT budget, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS over_capacity, 0::BIGINT AS needless_cuts, 0::BIGINT AS lost FROM context_budgets",
        "p7_checks": f"""
            WITH d AS (SELECT {source} AS source, count(*) AS documents FROM documents GROUP BY 1)
            SELECT {source.replace("source", "s.source")} AS source, coalesce(documents, 0) AS documents, false AS too_often, true AS on_target
            FROM source_weights s LEFT JOIN d ON d.source = {source.replace("source", "s.source")}""",
        "p8_checks": "SELECT count(*) AS documents, true AS near_raters FROM documents",
        "p4_found": """
            SELECT DISTINCT passage_id FROM passage_windows JOIN embed_models USING (embedding_model)
            WHERE length(text) > max_chars OR len(verse_ids) > max_verses""",
        "p5_found": top + " SELECT edge_id FROM r WHERE place <= 5",
        "p5_top_links": top + " SELECT book, chapter, verse, edge_id, votes, place::INT AS place FROM r WHERE place <= 5",
    }
