"""Lexical search, vector search, fusion, reranking and evaluation over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import coverage, dot, fallback_tokens, phrase_text, tokens, topic_tokens
from corpusmill.operators import evaluate as ev
from corpusmill.operators import fusion as fu
from corpusmill.operators.lexical import Index, build_index, load_index, save_index, search
from corpusmill.operators.ranking import place_in_parts
from corpusmill.operators.rules import detect_topics
from corpusmill.operators.vectors import LexicalStore, nearest
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage, scratch

#: Some fixed questions, before one for the label of every cluster; the fourth repeats a word, the fifth is a phrase of more than five characters.
QUESTIONS = [(1, "faithful covenant of the king"), (2, "the shepherd and the river"), (3, "wisdom"), (4, "king king bread"), (5, "see v. 24"), (6, "zzz nothing here"), (7, "el rey y el pan"), (8, "eternal judgment, remnant & promise!")]
FIRST_LABEL = 101
ASKED = "asked(query_id, text) AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + f") UNION ALL SELECT (row_number() OVER (ORDER BY cluster_id) + {FIRST_LABEL - 1})::INT, cluster_label FROM tsk_clusters)"
TOKENS = "[x FOR x IN string_split_regex(regexp_replace(lower({0}), '[^\\w\\s]', ' ', 'g'), '\\s+') IF x <> '']"
INDEX = f"""
    toks AS (SELECT doc_id, unnest({TOKENS.format("text")}) AS term FROM documents WHERE text IS NOT NULL),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
    len AS (SELECT d.doc_id, count(term) AS dl FROM documents d LEFT JOIN toks USING (doc_id) GROUP BY 1),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT query_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT query_id, {TOKENS.format("text")} AS t FROM asked)),
    qt AS (SELECT query_id, term, count(*) AS times, min(pos) AS first_at FROM q GROUP BY 1, 2),
    raw AS (SELECT query_id, doc_id, min(first_at) AS first_at,
                   sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.35::DOUBLE + 0.65::DOUBLE * dl / avgdl))) AS score
            FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id), stats GROUP BY 1, 2),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_at, doc_id) AS rank FROM raw)"""
PHRASE = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\w\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
BOOSTED = f"""{INDEX},
    win AS (SELECT l.query_id, l.doc_id, l.rank AS raw_rank, l.rank > 100 AS late,
                   CASE WHEN length({PHRASE.format("a.text")}) > 5 AND l.rank <= 100 AND contains({PHRASE.format("d.text")}, {PHRASE.format("a.text")}) THEN score * 1.5 ELSE score END AS score
            FROM lex l JOIN documents d USING (doc_id) JOIN asked a USING (query_id)),
    best AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY late, CASE WHEN NOT late THEN round(score, 9) END DESC, raw_rank) AS rank FROM win),
    top AS (SELECT * FROM best WHERE rank <= 25)"""
NORM = f"""{BOOSTED},
    norm AS (SELECT *, CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS norm
             FROM top WINDOW p AS (PARTITION BY query_id))"""


def _asked(t) -> DataFrame:
    """The fixed questions, and every cluster's label under its place by id."""
    labels = place_in_parts(t("tsk_clusters").select("cluster_id", F.col("cluster_label").alias("text"), F.lit(0).alias("all")), ["all"], [(F.substring("cluster_id", 1, 12), False)], [F.col("cluster_id")])
    return t.spark.createDataFrame(QUESTIONS, "query_id int, text string").unionByName(labels.select((F.col("place") + FIRST_LABEL - 1).cast("int").alias("query_id"), "text"))


def _docs(t) -> DataFrame:
    return t("documents").select("doc_id", "text")


def _index(t):
    return build_index(_docs(t), "doc_id", "text", keep=True)


_KEPT: dict[tuple, Index] = {}


def kept_index(t, name: str, docs: DataFrame, doc_id: str, text: str) -> Index:
    """The stored index of a table's documents: built and written once for a state of the table, read by every search.

    The searches ask a question for every label of a table, so the index is kept as documents with their terms; where ids
    repeat, it is stored by terms.
    """
    path = t.path(name)
    where = t.spark._jvm.org.apache.hadoop.fs.Path(path)
    state = where.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(where)
    key = (t.spark.sparkContext.applicationId, path, docs.columns[0], state.getModificationTime(), state.getLen())
    if key not in _KEPT:
        index = build_index(docs, doc_id, text, keep=True)
        if index.documents is None:
            folder = scratch(t.spark, f"index-{name}")
            save_index(index, folder)
            index = load_index(t.spark, folder)
        _KEPT[key] = index
    return _KEPT[key]


def _stored(t) -> Index:
    return kept_index(t, "documents", _docs(t), "doc_id", "text")


def _top(t, limit: int = 25) -> DataFrame:
    return search(_stored(t), _asked(t), "query_id", "text", limit, _docs(t))


def _vectors(t) -> DataFrame:
    """Driver vectors keyed by document: a vector belongs to the document of the same number."""
    return t("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("doc_vector"))


def _question_vectors(t, asked: DataFrame | None = None) -> DataFrame:
    """Each question's vector is the one of its number."""
    rows = t("embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    return (_asked(t) if asked is None else asked).select("query_id").join(rows, F.col("query_id") == F.col("vec_id")).select("query_id", "query_vector")


def _semantic(t) -> DataFrame:
    """Candidates with both ranks, of the questions that have a vector: others would lose their candidates, so they aren't searched."""
    rows = t("embeddings").select("vec_id")
    asked = cut_lineage(_asked(t).join(rows, F.col("query_id") == F.col("vec_id"), "left_semi"))
    top = search(_stored(t), asked, "query_id", "text", 25, _docs(t))
    return fu.semantic_rank(top, _question_vectors(t, asked), _vectors(t))


@query(f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents WHERE text IS NOT NULL)")
def b1_tokens(t):
    words = tokens(F.col("text"))
    return _docs(t).filter("text is not null").select("doc_id", F.size(words).alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("digest"))


@query(f"WITH {ASKED}, {INDEX} SELECT term, df FROM df")
def b2_document_frequency(t):
    return _index(t).terms.select("term", "df")


@query(f"WITH {ASKED}, {INDEX} SELECT term, doc_id, tf, dl FROM tf JOIN len USING (doc_id)")
def b2_postings(t):
    return _index(t).postings.select("term", "doc_id", "tf", "dl")


@query(f"WITH {ASKED}, {INDEX} SELECT n AS n_docs, round(avgdl, 6) AS avgdl FROM stats")
def b2_corpus_stats(t):
    return _index(t).stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {ASKED}, {INDEX} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM lex WHERE rank <= 10")
def b4_bm25_top(t):
    return search(_stored(t), _asked(t), "query_id", "text", 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ASKED}, {BOOSTED} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM top")
def b5_phrase_boost(t):
    return _top(t).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {ASKED}, {NORM} SELECT query_id, doc_id, rank::INT AS rank, round(norm, 5) AS norm FROM norm")
def b8_min_max(t):
    return fu.min_max(_top(t)).select("query_id", "doc_id", "rank", F.round("norm", 5).alias("norm"))


@query(
    f"""WITH {ASKED}, {NORM},
    lead AS (SELECT query_id, max(CASE WHEN rank = 1 THEN norm END) - arg_max(norm, CASE WHEN rank <= 5 THEN rank END) AS lead FROM norm GROUP BY 1)
    SELECT query_id, round(lead, 5) AS lead, len([x FOR x IN string_split_regex(trim(text), '\\s+') IF x <> '']) >= 4 AND lead < 0.15 AS open FROM lead JOIN asked USING (query_id)"""
)
def b9_gate(t):
    return fu.gate(_top(t), _asked(t), "query_id", "text").withColumn("lead", F.round("lead", 5))


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def b10_dot(t):
    a, b = t("embeddings").alias("a"), t("embeddings").alias("b")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.vec_id").alias("id_a"), F.col("b.vec_id").alias("id_b"), F.round(dot(F.col("a.embedding"), F.col("b.embedding")), 6).alias("dot"))


SEMANTIC = f"""{NORM},
    sem AS (SELECT n.query_id, n.doc_id, n.rank, n.norm, list_inner_product(qv.embedding::DOUBLE[], dv.embedding::DOUBLE[]) AS similarity
            FROM norm n JOIN embeddings qv ON qv.vec_id = n.query_id LEFT JOIN embeddings dv ON dv.vec_id = n.doc_id),
    semr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST, rank) AS rank_sem FROM sem)"""


@query(f"WITH {ASKED}, {SEMANTIC} SELECT query_id, doc_id, rank::INT AS rank, rank_sem::INT AS rank_sem, round(similarity, 6) AS similarity FROM semr")
def b11_semantic_rank(t):
    near = _semantic(t)
    return near.select("query_id", "doc_id", "rank", "rank_sem", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {ASKED}, {SEMANTIC} SELECT query_id, doc_id, round(1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + rank_sem), 9) AS score FROM semr")
def b12_rrf(t):
    near = _semantic(t)
    return near.select("query_id", "doc_id", F.round(fu.rrf(F.col("rank"), F.col("rank_sem")), 9).alias("score"))


HYBRID = f"""{SEMANTIC},
    lead AS (SELECT query_id, max(CASE WHEN rank = 1 THEN norm END) - arg_max(norm, CASE WHEN rank <= 5 THEN rank END) AS lead FROM norm GROUP BY 1),
    gate AS (SELECT query_id, len([x FOR x IN string_split_regex(trim(text), '\\s+') IF x <> '']) >= 4 AND lead < 0.15 AS open FROM lead JOIN asked USING (query_id)),
    fused AS (SELECT query_id, doc_id, rank, CASE WHEN open THEN 1.0::DOUBLE / (60 + rank) + 1.0::DOUBLE / (60 + rank_sem) ELSE norm END AS score FROM semr JOIN gate USING (query_id)),
    hyb AS (SELECT query_id, doc_id, score, row_number() OVER w AS rank FROM fused WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, rank) QUALIFY row_number() OVER w <= 5)"""


def _hybrid(t) -> DataFrame:
    vectors = _question_vectors(t)
    asked = _asked(t).join(F.broadcast(vectors), "query_id", "left")  # one row per question
    return fu.hybrid_search(_stored(t), _docs(t), _vectors(t), asked, "query_id", "text", "query_vector")


@query(f"WITH {ASKED}, {HYBRID} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM hyb")
def b13_hybrid(t):
    return _hybrid(t).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {ASKED}, {NORM},
    sig AS (SELECT query_id, doc_id, rank, norm + 0.15::DOUBLE * (doc_id % 7 = 0)::INT + 0.10::DOUBLE * 0.5 + 0.10::DOUBLE * least(1.0, (doc_id % 5) / 4.0) + 0.05::DOUBLE * (doc_id % 3 = 0)::INT AS score FROM norm)
    SELECT query_id, rank() OVER w::INT AS rank, round(score, 5) AS score FROM sig WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, rank) QUALIFY row_number() OVER w <= 8"""
)
def b14_rerank(t):
    docs = t("documents").select("doc_id")
    signals = {
        "direct": docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("double").alias("value")), "topic": docs.select("doc_id", ((F.col("doc_id") % 5) / 4.0).alias("value")),
        "crossref": docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("double").alias("value")),
    }
    norm = fu.min_max(_top(t)).select("query_id", "doc_id", F.col("norm").alias("score"), "rank")
    return fu.rerank(norm, signals, 8).select("query_id", "rank", F.round("score", 5).alias("score"))


@query(f"WITH {ASKED}, {NORM} SELECT query_id, doc_id, round(norm, 5) AS score, rank::INT AS rank FROM norm")
def b15_lexical_store(t):
    store = LexicalStore(_stored(t), _docs(t))
    return store.query(_asked(t), 25).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


@query(
    """SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id)::INT AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 10"""
)
def b16_nearest(t):
    """The questions of all searches: every row whose id is divisible by 50, so their number grows with the table."""
    asked = t("embeddings").filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return nearest(asked, _vectors(t), 10).withColumn("score", F.round("score", 6))


@query(
    """WITH l AS (SELECT DISTINCT label FROM embeddings), r AS (
    SELECT a.vec_id AS query_id, b.vec_id, b.label = a.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank
    FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY rank <= 10)
    SELECT query_id, round(sum((hit AND rank <= 5)::INT) / 5.0::DOUBLE, 6) AS precision_at_5, coalesce(min(CASE WHEN hit THEN rank END) = 1, false)::INT AS hit_at_1,
    coalesce(min(CASE WHEN hit THEN rank END) <= 5, false)::INT AS hit_at_5, round(coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN rank END), 0), 6) AS mrr FROM r GROUP BY 1"""
)
def g17_ranking_metrics(t):
    rows = t("embeddings")
    asked = rows.filter(F.col("vec_id") % 50 == 0)
    found = nearest(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), rows.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("doc_vector")), 11)
    by = Window.partitionBy("query_id").orderBy("rank")
    found = found.filter("query_id <> doc_id").withColumn("rank", F.row_number().over(by)).filter("rank <= 10")
    labels = rows.select(F.col("vec_id").alias("doc_id"), "label")
    marked = found.join(labels, "doc_id").join(labels.toDF("query_id", "own"), "query_id")
    return ev.ranking_metrics(marked.select("query_id", "rank", (F.col("label") == F.col("own")).alias("hit")))


@query(
    f"""WITH {ASKED}, {NORM},
    s AS (SELECT *, sum(norm) OVER (PARTITION BY query_id) AS total FROM norm),
    e AS (SELECT query_id, count(*) AS n, max(CASE WHEN rank = 1 THEN norm END) AS top1, arg_max(norm, CASE WHEN rank <= 5 THEN rank END) AS fifth,
          coalesce(sum(CASE WHEN total > 0 AND norm > 0 THEN -(norm / total) * log2(norm / total) END), 0) AS bits FROM s GROUP BY 1)
    SELECT query_id, n, round(top1, 6) AS top1, round(top1 - fifth, 6) AS lead5, round(CASE WHEN n > 1 THEN bits / log2(greatest(n, 2)) ELSE 0 END, 6) AS entropy FROM e"""
)
def g10_diagnostics(t):
    norm = fu.min_max(_top(t)).select("query_id", "doc_id", F.col("norm").alias("score"), "rank")
    return fu.diagnostics(norm)


@query(f"WITH {ASKED}, {NORM}, m AS (SELECT query_id, avg(norm) AS m FROM norm WHERE rank <= 5 GROUP BY 1) SELECT a.query_id, coalesce(m, 0) < 0.75 AS low FROM asked a LEFT JOIN m USING (query_id)")
def g11_low_confidence(t):
    norm = fu.min_max(_top(t)).select("query_id", "doc_id", F.col("norm").alias("score"), "rank")
    return fu.low_confidence(norm, _asked(t), "query_id")


STOP = "the and for with that this from what when where which can could should would does did are is to of in on a an about christian christians bible say"
FALLBACK = "list_distinct([x FOR x IN string_split_regex(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') IF length(x) >= 3 AND NOT list_contains(string_split('" + STOP + "', ' '), x)])"


@query(
    f"""WITH {ASKED}, {BOOSTED}, ft AS (SELECT query_id, {FALLBACK.format("text")} AS t FROM asked),
    c AS (SELECT top.query_id, top.rank, CASE WHEN len(ft.t) = 0 THEN 1.0 ELSE len([w FOR w IN ft.t IF contains(lower(d.text), w)]) / len(ft.t)::DOUBLE END AS covered
    FROM top JOIN ft USING (query_id) JOIN documents d USING (doc_id))
    SELECT query_id, rank::INT AS rank, round(covered, 6) AS covered FROM c"""
)
def g13_coverage(t):
    words = _asked(t).select("query_id", fallback_tokens(F.col("text")).alias("words"))
    met = _top(t).join(_docs(t), "doc_id").join(words, "query_id")
    return met.select("query_id", "rank", F.round(coverage(F.col("words"), F.col("text")), 6).alias("covered"))


@query("""SELECT n AS results, c AS covered, round((least(n / 4.0::DOUBLE, 1.0) + c) / 2, 6) AS confidence, n < 4 OR c < 0.6 OR (least(n / 4.0::DOUBLE, 1.0) + c) / 2 < 0.75 AS widen FROM (SELECT unnest(range(0, 7)) AS n), (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) AS c)""")
def g14_widen_decision(t):
    counts = t.spark.range(0, 7).withColumnRenamed("id", "results")
    shares = t.spark.createDataFrame([(x / 4,) for x in range(5)], "covered double")
    rows = counts.crossJoin(shares)  # 7 by 5 rows
    made = rows.withColumn("d", fu.widen_decision(F.col("results"), F.col("covered")))
    return made.select("results", "covered", "d.confidence", "d.widen")


TOPICS = [(1, "covenant and promise", ["covenant", "promise", "king"]), (2, "shepherd", ["shepherd", "flock", "river"]), (3, "judgment", ["judgment", "remnant", "eternal", "promise"]), (4, "bread", ["bread", "rey", "pan", "table", "wine"])]


@query(
    f"""WITH {ASKED}, topics(topic_id, words) AS (VALUES {", ".join(f"({i}, {w})" for i, _, w in TOPICS)}),
    a AS (SELECT query_id, list_distinct([x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF length(x) >= 3]) AS t FROM asked),
    s AS (SELECT query_id, topic_id, len([w FOR w IN words IF list_contains(t, w)]) / len(words)::DOUBLE AS score FROM a, topics),
    b AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM s)
    SELECT query_id, topic_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, topic_id)::INT AS place FROM b
    WHERE (top >= 0.4 AND score >= 0.4) OR (top < 0.4 AND top >= 0.2 AND score > 0) QUALIFY place <= 3"""
)
def b19_topic_detection(t):
    topics = t.spark.createDataFrame([(i, w) for i, _, w in TOPICS], "topic_id int, words array<string>")
    return detect_topics(_asked(t), topics).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, length(trim(regexp_replace(regexp_replace(lower(text), '[^\\w\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_phrase, len([x FOR x IN string_split_regex(lower(text), '[^a-z0-9]+') IF length(x) >= 3])::INT AS n_topic FROM documents WHERE text IS NOT NULL")
def f3_phrase_and_topic_words(t):
    return _docs(t).filter("text is not null").select("doc_id", F.length(phrase_text(F.col("text"))).cast("long").alias("n_phrase"), F.size(topic_tokens(F.col("text"))).alias("n_topic"))


@query(
    """SELECT event_type, count(*) AS runs, round(avg(value), 2) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1"""
)
def g15_latency_summary(t):
    return ev.latency_summary(t("events"), "event_type", "value")


@query(
    """WITH h AS (SELECT event_type, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 2) AS a, round(avg(CASE WHEN event_id % 2 = 1 THEN value END), 2) AS b FROM events GROUP BY 1)
    SELECT event_type, round(b - a, 6) AS mean FROM h"""
)
def g16_run_deltas(t):
    rows = t("events")
    base, other = (ev.latency_summary(rows.filter(F.col("event_id") % 2 == i), "event_type", "value") for i in (0, 1))
    return ev.deltas(base, other, "event_type", ["mean"])


@query(
    """WITH h AS (SELECT user_id, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 2) AS a, round(avg(CASE WHEN event_id % 2 = 1 THEN value END), 2) AS b FROM events GROUP BY 1)
    SELECT user_id, 'mean' AS metric, round(b - a, 6) AS change FROM h WHERE round(b - a, 6) > 5"""
)
def g19_regressions(t):
    rows = t("events")
    base, other = (ev.latency_summary(rows.filter(F.col("event_id") % 2 == i), "user_id", "value") for i in (0, 1))
    return ev.regressions(ev.deltas(base, other, "user_id", ["mean"]), "user_id", {"mean": 5.0})
