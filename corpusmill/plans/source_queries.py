"""Sources, sinks, metadata, traces, answers and prompts over the test tables, mostly as round trips through file layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import answers as an
from corpusmill.functions import citations as ci
from corpusmill.functions import editions as ed
from corpusmill.functions import refs
from corpusmill.functions import text as tx
from corpusmill.functions.layers import hebrew_preview
from corpusmill.operators import layers as la
from corpusmill.operators import lookup as lo
from corpusmill.operators import rules as ru
from corpusmill.operators import sequence as sq
from corpusmill.operators import traces as tr
from corpusmill.operators.lexical import build_index, load_index, save_index, search
from corpusmill.plans.data_queries import BSB, LATEST, _bsb, _latest
from corpusmill.plans.registry import query
from corpusmill.plans.retrieval_queries import ASKED, BOOSTED, INDEX, _asked, _docs, kept_index
from corpusmill.session import scratch
from corpusmill.sources import readers as rd
from corpusmill.sources import tables as tb
from corpusmill.sources import writers as wr

CODES = "codes(code, ordinal, testament) AS (VALUES " + ", ".join(f"('{c}', {i + 1}, '{'OT' if i < refs.FIRST_TESTAMENT else 'NT'}')" for i, c in enumerate(refs.BOOK_CODES)) + ")"
GENRES = "genres(code, genre) AS (VALUES " + ", ".join(f"('{c}', '{g}')" for g, books in ed.GENRES.items() for c in books.split()) + ")"
WORDS = "array<struct<word:string,strongs:string,gloss:string,morph:string,transliteration:string>>"


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ref", refs.verse_id(F.col("book"), F.col("chapter"), F.col("verse")))


# ---------------------------------------------------------------- translations, metadata, flags


@query("SELECT row_id, CASE WHEN upper(trim(translation)) IN ('BSB', 'KJV', 'WEB', 'ASV', 'NHEB') THEN upper(trim(translation)) ELSE 'BSB' END AS allowed, CASE upper(trim(translation)) WHEN 'WEB' THEN 'World' ELSE upper(trim(translation)) END AS alias FROM verses")
def p10_translations(t):
    """P10 and P11: the translations that can be asked for, and an alias written out."""
    code = F.col("translation")
    return t("verses").select("row_id", ed.allowed_translation(code).alias("allowed"), ed.translation_alias(code, {"WEB": "World"}).alias("alias"))


@query(
    f"""WITH {BSB}, {CODES}, {GENRES}, v AS (SELECT book || ' ' || chapter || ':' || verse AS verse_id, book, lower(text) AS t FROM bsb)
    SELECT verse_id, testament, genre, translate(verse_id, ':', '.') AS ord, list_filter([{", ".join("CASE WHEN " + " OR ".join(f"contains(t, '{w}')" if " " in w else f"regexp_matches(t, '{chr(92)}b{w}{chr(92)}b')" for w in words) + f" THEN '{name}' END" for name, words in ed.THEMES)}], lambda x: x IS NOT NULL) AS themes
    FROM v JOIN codes ON code = book JOIN genres USING (code)"""
)
def p21_verse_metadata(t):
    return ed.verse_metadata(_keyed(_bsb(t)), "ref", "text")


@query("SELECT upper(trim(cluster_label)) AS key, max(coalesce(least(1.0::DOUBLE, greatest(0.0, vote_total / 100.0::DOUBLE - 1)), 0.5)) AS value FROM tsk_clusters WHERE trim(cluster_label) <> '' GROUP BY 1")
def s15_metadata_confidence(t):
    rows = t("tsk_clusters").select("cluster_label", (F.col("vote_total") / 100.0 - 1).alias("c"))
    return ed.metadata_confidence(rows, "cluster_label", "c")


@query("SELECT DISTINCT lower(trim(cluster_label)) AS topic_id FROM tsk_clusters WHERE trim(cluster_label) <> ''")
def s16_topics(t):
    rows = t("tsk_clusters").select(F.col("cluster_label").alias("topic_id"), F.array("cluster_label").alias("synonyms"))
    return ru.clean_topics(rows).select("topic_id")


@query(
    """WITH a AS (SELECT unnest(member_verse_ids) AS item, lower(trim(cluster_label)) AS topic_id, least(1.0::DOUBLE, greatest(0.0, coalesce(vote_total / 100.0::DOUBLE - 1, 0))) AS confidence FROM tsk_clusters)
    SELECT item, topic_id, max(confidence) AS confidence FROM a WHERE confidence > 0 GROUP BY 1, 2"""
)
def s17_verse_topics(t):
    rows = t("tsk_clusters").select(F.explode("member_verse_ids").alias("item"), F.col("cluster_label").alias("topic_id"), (F.col("vote_total") / 100.0 - 1).alias("confidence"))
    return ru.clean_assignments(rows, "item")


@query(f"""SELECT doc_id, coalesce(regexp_matches(text, '(?i)\\b(?:{"|".join(ed.SKY_WORDS)})\\b'), false) AS sky FROM documents""")
def p16_sky_questions(t):
    return t("documents").select("doc_id", ed.asks_about_the_sky(F.col("text")).alias("sky"))


@query(f"WITH {CODES} SELECT row_id, ordinal || '/' || chapter AS path FROM verses LEFT JOIN codes ON code = upper(trim(book))")
def f46_chapter_paths(t):
    return t("verses").select("row_id", ed.chapter_path(F.upper(F.trim("book")), F.col("chapter")).alias("path"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') = '1' AS on_, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 7.5::DOUBLE) AS number, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS origin,
    CASE event_type WHEN 'click' THEN 'own:click' WHEN 'view' THEN 'own:view' ELSE event_type END AS model, user_id % 600 IN (408, 425, 429) OR user_id % 600 >= 500 AS retry FROM events"""
)
def p18_settings(t):
    """P18, P19, F41 and the pure part of S23: flags, numbers, origins, model names, and errors worth a retry."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    return t("events").select(
        "event_id", ed.flag(k).alias("on_"), ed.number_or(k, 7.5).alias("number"), ed.allowed_origin(kind, ["click", "view"]).alias("origin"), ed.model_id(kind, "click", "view", "own").alias("model"), ed.may_retry((F.col("user_id") % 600).cast("int")).alias("retry")
    )


# ---------------------------------------------------------------- traces


@query(
    """WITH items AS (SELECT DISTINCT user_id AS query_id, event_type AS item FROM events), said AS (SELECT user_id AS query_id, event_type AS item, list('topic_guard:' || event_id ORDER BY event_id) AS said FROM events WHERE event_type = 'purchase' GROUP BY 1, 2),
    ran AS (SELECT DISTINCT user_id AS query_id FROM events WHERE event_type = 'signup'), ranked AS (SELECT user_id AS query_id, event_type AS item, count(*) AS rank FROM events WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT query_id, item, list_concat([CASE WHEN rank IS NOT NULL THEN 'hybrid_final_rank:' || rank WHEN query_id IN (SELECT query_id FROM ranked) THEN 'selected_outside_hybrid_ranked_candidates' ELSE 'selected_without_hybrid_candidates' END], coalesce(said, []),
    CASE WHEN said IS NULL THEN ['topic_guard:not_invoked'] ELSE [] END, [CASE WHEN query_id IN (SELECT query_id FROM ran) THEN 'curation:unchanged' ELSE 'curation:not_invoked' END]) AS traces
    FROM items LEFT JOIN said USING (query_id, item) LEFT JOIN ranked USING (query_id, item)"""
)
def p20_decision_traces(t):
    rows = t("events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("item"), "event_id")
    said = rows.filter("item = 'purchase'").select("query_id", "item", F.col("event_id").alias("ord"), F.concat(F.lit("topic_guard:"), "event_id").alias("trace"))
    ran = rows.filter("item = 'signup'").select("query_id", F.lit("curation").alias("stage")).distinct()
    ranks = rows.filter("item = 'click'").groupBy("query_id", "item").agg(F.count("*").alias("rank"))
    return tr.selection_traces(tr.decision_traces(rows.select("query_id", "item").distinct(), said, ran), ranks)


# ---------------------------------------------------------------- layers of words


@query("WITH f AS (SELECT book, chapter, verse, c, min(word_id) AS first FROM gloss_words WHERE c <> '' GROUP BY 1, 2, 3, 4) SELECT book, chapter, verse, list(c ORDER BY first, c) AS ids FROM f GROUP BY 1, 2, 3")
def j16_clause_ids(t):
    return la.clause_ids(t("gloss_words"), ["book", "chapter", "verse"], "word_id", "c")


@query("WITH k AS (SELECT c, min(g) AS said FROM gloss_words WHERE g <> '' AND c <> '' AND word_pos = 1 GROUP BY 1) SELECT DISTINCT book, c, said FROM gloss_words JOIN k USING (c)")
def j16_clause_translations(t):
    rows = t("gloss_words")
    known = rows.filter("word_pos = 1 and c <> ''").select("c", F.col("g").alias("said"))
    return la.clause_translations(rows, known, "book", "c", "said")


@query(
    """WITH x AS (SELECT word_pos, min(nullif(trim(lex), '')) AS by_key FROM gloss_words WHERE word_pos IS NOT NULL GROUP BY 1)
    SELECT word_id, coalesce(CASE WHEN verse = 1 THEN nullif(trim(tr), '') END, by_key, nullif(trim(g), '')) AS gloss FROM gloss_words LEFT JOIN x USING (word_pos)"""
)
def j17_gloss_precedence(t):
    rows = t("gloss_words").withColumn("own", F.when(F.col("verse") == 1, F.col("tr")))
    return la.gloss_by_precedence(rows, t("gloss_words").select("word_pos", F.col("lex").alias("gloss")), "word_pos", "own", "g").select("word_id", "gloss")


@query(f"""WITH {BSB}, w AS (SELECT upper(trim(book)) AS book, chapter, verse, list(word_id ORDER BY word_id) AS words FROM gloss_words GROUP BY 1, 2, 3) SELECT row_id, coalesce(words, []::BIGINT[]) AS words FROM bsb LEFT JOIN w USING (book, chapter, verse)""")
def s36_bundled_chapters(t):
    words = t("gloss_words").groupBy(F.upper(F.trim("book")).alias("book"), "chapter", "verse").agg(F.array_sort(F.collect_list("word_id")).alias("words"))
    return la.bundled_chapters(_bsb(t), words, ["book", "chapter", "verse"], "words").select("row_id", "words")


@query(f"""WITH {BSB}, w AS (SELECT upper(trim(book)) AS book, chapter, verse, list(word_id ORDER BY word_id) FILTER (s IS NOT NULL) AS words FROM gloss_words GROUP BY 1, 2, 3) SELECT row_id, CASE WHEN len(words) > 0 THEN words ELSE [row_id] END AS words FROM bsb LEFT JOIN w USING (book, chapter, verse)""")
def j5_attach_if_any(t):
    words = t("gloss_words").groupBy(F.upper(F.trim("book")).alias("book"), "chapter", "verse").agg(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.col("word_id")))).alias("words"))
    return lo.attach_if_any(_bsb(t).withColumn("words", F.array("row_id")), words, ["book", "chapter", "verse"], "words").select("row_id", "words")


# ---------------------------------------------------------------- sources


@query(
    """SELECT passage_id, anchor_verse, [upper(x) FOR x IN verse_ids] AS verse_ids, text FROM passage_windows WHERE passage_id <> '' AND anchor_verse <> '' AND verse_ids IS NOT NULL AND text <> ''"""
)
def s34_passage_items(t):
    item = F.struct(F.col("passage_id").alias("passageId"), F.col("anchor_verse").alias("anchorVerse"), F.transform("verse_ids", F.lower).alias("verseIds"), "text")
    return tb.passage_items(t("passage_windows").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body")), "body")


@query(
    """SELECT cluster_id, cluster_label AS label, [upper(x) FOR x IN member_verse_ids] AS member_verse_ids, coalesce(vote_total, 0) AS vote_total, md5(cluster_label || ': ' || array_to_string(member_verse_ids[1:25], ' | ')) AS digest
    FROM tsk_clusters WHERE cluster_label <> '' AND member_verse_ids IS NOT NULL"""
)
def s34_cluster_items(t):
    item = F.struct(F.col("cluster_id").alias("clusterId"), F.col("cluster_label").alias("clusterLabel"), F.col("member_verse_ids").alias("memberVerseIds"), F.col("vote_total").alias("voteTotal"))
    return tb.cluster_items(t("tsk_clusters").select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body")), "body").withColumn("digest", F.md5("text")).drop("text")


@query(f"WITH {LATEST} SELECT book, chapter, verse, trim(text) AS text, 'OWN' AS translation FROM latest WHERE text <> ''")
def s33_aliased_rows(t):
    """Half of the rows have their parts in columns of their own, half a reference in the verse column."""
    rows, own = _keyed(_latest(t)), F.col("chapter") % 2 == 0
    named = rows.select(
        F.when(own, F.col("book")).alias("Book Name"), F.when(own, F.col("chapter").cast("string")).alias("Chap."), F.when(own, F.col("verse").cast("string")).otherwise(F.col("ref")).alias("V"), F.col("text").alias("Berean Standard Bible"),
    )
    return tb.aliased_verse_rows(named, "OWN")


@query(
    f"""WITH {LATEST}, {CODES} SELECT book || ' ' || chapter || ':' || verse AS ref, max(trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*?\\]', '', 'g'), '\\s+', ' ', 'g'))) AS text FROM latest JOIN codes ON code = book
    WHERE trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*?\\]', '', 'g'), '\\s+', ' ', 'g')) <> '' GROUP BY 1"""
)
def s35_numbered_lines(t):
    rows = _latest(t).withColumn("text", F.regexp_replace("text", "[\r\n]", " "))
    lines = rows.select(F.concat_ws("\t", F.coalesce(refs.book_ordinal(F.col("book")).cast("string"), F.lit("99")), "chapter", "verse", "text").alias("value"))
    return tb.numbered_verse_lines(lines)


CHAPTER_RANGES = f"""{LATEST}, k AS (SELECT passage_id, split_part(passage_id, '.', 1) AS book, split_part(passage_id, '.', 2)::INT AS chapter, split_part(split_part(passage_id, '.', 3), '-', 1)::INT AS lo, split_part(passage_id, '.', 4)::INT AS hi FROM passage_windows)"""


def _ranges(t) -> DataFrame:
    ends = [F.split_part("passage_id", F.lit("-"), F.lit(i)) for i in (1, 2)]
    return t("passage_windows").select(
        F.col("passage_id").alias("key_id"), F.split_part("passage_id", F.lit("."), F.lit(1)).alias("book"), F.split_part("passage_id", F.lit("."), F.lit(2)).cast("int").alias("chapter"), F.split_part(ends[0], F.lit("."), F.lit(3)).cast("int").alias("first"),
        F.split_part(ends[1], F.lit("."), F.lit(2)).cast("int").alias("last"),
    )


@query(f"WITH {CHAPTER_RANGES} SELECT passage_id AS key_id, md5(trim(string_agg(text, ' ' ORDER BY verse))) AS digest FROM k JOIN latest l ON tr = 'BSB' AND k.book = l.book AND k.chapter = l.chapter AND verse BETWEEN lo AND hi GROUP BY 1")
def f18_range_texts(t):
    return rd.chapter_range(_bsb(t).select("book", "chapter", "verse", "text"), _ranges(t)).select("key_id", F.md5("text").alias("digest"))


@query(
    f"WITH {CHAPTER_RANGES} SELECT passage_id AS key_id, md5(trim(string_agg(trim(text), ' ' ORDER BY verse))) AS digest FROM k JOIN latest l ON tr = 'KJV' AND k.book = l.book AND k.chapter = l.chapter AND verse BETWEEN lo AND hi GROUP BY 1"
)
def s20_chapter_replies(t):
    """Chapters as the JSON of a text service, read back by ranges."""
    rows = _latest(t).filter("tr = 'KJV'")
    content = F.array_sort(F.collect_list(F.struct(F.col("verse").alias("number"), F.lit("verse").alias("type"), F.array("text").alias("content"))))
    replies = rows.groupBy(F.col("tr").alias("translation"), "book", "chapter").agg(F.to_json(F.struct(F.struct(content.alias("content")).alias("chapter"))).alias("body"))
    return tb.chapter_reply_range(replies, _ranges(t).withColumn("translation", F.lit("KJV"))).select("key_id", F.md5("text").alias("digest"))


@query("SELECT row_id, nullif(replace(trim(text), chr(10), ' '), '') AS text FROM verses")
def s21_verse_replies(t):
    return t("verses").select("row_id", tb.verse_reply_text(F.to_json(F.struct("text"))).alias("text"))


@query("SELECT book, chapter, verse, list('w' || word_pos || '=' || trim(s) ORDER BY word_id) AS words FROM gloss_words WHERE trim(s) <> '' GROUP BY 1, 2, 3")
def s22_tagged_words(t):
    """Words with lexicon tags as the JSON of a text service, read back."""
    tagged = F.concat(F.lit("<span>w"), "word_pos", F.lit("</span><S>"), F.trim("s"), F.lit("</S>"))
    verse = t("gloss_words").filter(F.length(F.trim("s")) > 0).groupBy("book", "chapter", "verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", tagged.alias("w")))), lambda x: x["w"]), " ").alias("text"))
    replies = verse.groupBy("book", "chapter").agg(F.to_json(F.collect_list(F.struct("verse", "text"))).alias("body"))
    return tb.tagged_chapter_words(replies, "body").select("book", "chapter", "verse", F.transform("words", lambda w: F.concat(w["word"], F.lit("="), w["strongs"])).alias("words"))


@query("SELECT passage_id, md5(coalesce(text, '') || coalesce(anchor_verse, '') || 'ab') AS digest FROM passage_windows")
def f26_flat_content(t):
    node = F.struct(F.array(F.struct(F.lit("p").alias("type"), F.array(F.struct(F.coalesce("text", F.lit("")).alias("text"))).alias("content")), F.struct(F.lit("q").alias("type"), F.array(F.struct(F.concat(F.coalesce("anchor_verse", F.lit("")), F.lit("ab")).alias("text"))).alias("content"))).alias("children"))
    bodies = t("passage_windows").select("passage_id", F.to_json(node).alias("body"))
    return bodies.select("passage_id", F.md5(tb.flat_content("body")).alias("digest"))


@query("SELECT cluster_id, [x FOR x IN [lower(trim(cluster_label)), 'one two three'] IF len(string_split_regex(x, '\\s+')) <= 3] AS found FROM tsk_clusters WHERE trim(cluster_label) <> '' AND NOT contains(cluster_label, '''') AND NOT contains(cluster_label, ']')")
def s37_rule_literals(t):
    rows = t("tsk_clusters").filter(F.length(F.trim("cluster_label")) > 0).filter("not contains(cluster_label, \"'\") and not contains(cluster_label, ']')")
    source = F.concat(F.lit("{ keywords: ['"), "cluster_label", F.lit("', 'one two three'], } { keywords: ['one two three four'] }"))
    return rows.select("cluster_id", tb.literals_of_rules(source).alias("found"))


@query("SELECT row_id, ((row_number() OVER (ORDER BY row_id) - 1) // 200)::INT AS batch FROM verses")
def k8_batches(t):
    return tb.numbered_batches(t("verses").select("row_id"), "row_id", 200)


@query(f"WITH {LATEST} SELECT tr AS translation, book, chapter, verse, text FROM latest")
def s6_translation_books(t):
    """Verses as one JSON map a book and translation, read back."""
    rows = _latest(t).groupBy("tr", "book", "chapter").agg(F.map_from_entries(F.collect_list(F.struct(F.col("verse").cast("string"), "text"))).alias("verses"))
    books = rows.groupBy("tr", "book").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("chapter").cast("string"), "verses")))).alias("text"))
    return rd.translation_book_rows(books.select(F.concat(F.lit("/some/where/"), F.lower("tr"), F.lit("-"), "book", F.lit(".json")).alias("path"), "text"))


@query("SELECT book, chapter, verse, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY word_id)::INT AS at, w, m FROM gloss_words WHERE book IS NOT NULL AND chapter IS NOT NULL AND verse IS NOT NULL")
def s10_layer_words(t):
    """Tagged words as one JSON map a book, read back."""
    own = t("gloss_words").filter("book is not null and chapter is not null and verse is not null")
    verse = own.groupBy("book", "chapter", "verse").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "w", "m"))), lambda x: F.struct(x["w"].alias("w"), x["m"].alias("m"))).alias("words"))
    chapter = verse.groupBy("book", "chapter").agg(F.map_from_entries(F.collect_list(F.struct(F.col("verse").cast("string"), "words"))).alias("verses"))
    books = chapter.groupBy("book").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("chapter").cast("string"), "verses")))).alias("text"))
    return rd.layer_word_rows(books.select(F.concat(F.lit("x/layer-"), "book", F.lit(".json")).alias("path"), "text"), "w string, m string")


PLAIN_LINE = "trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*?\\]', '', 'g'), '[\\r\\n]', ' ', 'g'))"


@query(f"WITH {LATEST} SELECT 'OWN' AS translation, book, chapter, verse, nullif({PLAIN_LINE}, '') AS text FROM latest WHERE tr = 'BSB'")
def s25_delimited_verses(t):
    """Verses as semicolon-separated files with other header names, read back."""
    path = scratch(t.spark, "verses")
    rows = _bsb(t).select(F.col("book").alias("Book Name"), F.col("chapter").alias("Chap"), F.col("verse").alias("V"), F.regexp_replace("text", "[\r\n]", " ").alias("Scripture"))
    rows.write.csv(path, sep=";", header=True, quote='"', escape='"')
    return rd.verse_table(t.spark, path, "OWN").withColumn("text", F.nullif("text", F.lit("")))


@query("SELECT book, chapter, verse, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY word_id)::INT AS at, replace('<' || word_pos || '> & \"x', '/', '') AS word, CASE WHEN regexp_matches(s, '[0-9]') THEN 'H' || regexp_extract(s, '([0-9]+)', 1) END AS strongs, nullif(coalesce(md, ''), '') AS morph FROM gloss_words")
def s26_osis_words(t):
    """Words as verse and word elements, read back: S26, F22 and F23."""
    word = F.concat(F.lit('<w lemma="b/'), F.coalesce("s", F.lit("")), F.lit('" morph="'), F.coalesce("md", F.lit("")), F.lit('">&lt;'), "word_pos", F.lit("&gt;/ &amp; &quot;x</w>"))
    verse = t("gloss_words").groupBy("book", "chapter", "verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_id", word.alias("w")))), lambda x: x["w"]), "\n").alias("body"))
    files = verse.select(F.concat(F.lit('<a><verse n="1" osisID="'), "book", F.lit("."), "chapter", F.lit("."), "verse", F.lit('">\n'), "body", F.lit("</verse></a>")).alias("text"))
    return rd.osis_words(files)


OUTER_SPACE = r"'^[\s\p{Z}\x{85}\x{FEFF}]+|[\s\p{Z}\x{85}\x{FEFF}]+$'"


@query(f"SELECT word_id, regexp_replace(w, {OUTER_SPACE}, '', 'g') AS a, regexp_replace(i, {OUTER_SPACE}, '', 'g') AS b FROM greek_interlinear WHERE w IS NOT NULL AND i IS NOT NULL AND NOT regexp_matches(w || i, '[\\t\\n\\r〔｜〕]')")
def s30_packed_fields(t):
    """Fields packed in brackets within tab-separated lines, read back: S27 to S30."""
    rows = t("greek_interlinear").filter("w is not null and i is not null").filter(~F.rlike(F.concat("w", "i"), F.lit("[\t\n\r〔｜〕]")))
    lines = rows.select(F.concat("word_id", F.lit("\t〔"), "w", F.lit("｜"), "i", F.lit("〕")).alias("value"))
    return rd.packed_rows(lines, 1, ["a", "b"]).select(F.get("c", F.lit(0)).cast("long").alias("word_id"), "a", "b")


@query("SELECT c_custkey AS key, c_name AS name FROM customer")
def s31_wrapped_json(t):
    files = t("customer").select(F.concat(F.lit("var data = "), F.to_json(F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))), F.lit("; module.exports = data;")).alias("text"))
    return rd.wrapped_json(files, "key long, name string").select("value.key", "value.name")


@query(f"WITH {BSB} SELECT book, chapter, verse, text FROM bsb")
def s32_nested_books(t):
    chapters = _bsb(t).groupBy("book", "chapter").agg(F.collect_list(F.struct("verse", "text")).alias("verses"))
    books = chapters.groupBy(F.col("book").alias("name")).agg(F.collect_list(F.struct("chapter", "verses")).alias("chapters"))
    return rd.nested_books(books.select(F.to_json(F.struct(F.array(F.struct("name", "chapters")).alias("books"))).alias("text")))


# ---------------------------------------------------------------- sinks


@query(f"WITH {LATEST} SELECT row_id, tr AS translation, book, md5(text) AS digest FROM latest")
def k1_partitioned_table(t):
    """The latest verses by translation and book, written and read back: K1, K10, S8."""
    path = scratch(t.spark, "partitioned")
    wr.write_partitioned(_latest(t).withColumnRenamed("tr", "translation"), path, ["translation", "book"], ["chapter", "verse"])
    return t.spark.read.parquet(path).select("row_id", "translation", "book", F.md5("text").alias("digest"))


@query("SELECT 'read' AS step, count(*) AS rows, true AS kept FROM verses UNION ALL SELECT 'same sources', 0, true UNION ALL SELECT 'other sources', 0, false UNION ALL SELECT 'nothing there', 0, false")
def k9_envelope(t):
    """A table with its version and source hash, read back, and whether sources count as unchanged: K2, K9."""
    path, source = scratch(t.spark, "envelope"), scratch(t.spark, "source")
    t("embed_models").write.parquet(source)
    digest = rd.content_hash(t.spark, source)
    wr.write_envelope(t.spark, t("verses").select("row_id", "text"), path, wr.Envelope("1", "own", digest))
    rows = wr.read_envelope(t.spark, path, "1").agg(F.lit("read").alias("step"), F.count("*").alias("rows"), F.lit(True).alias("kept"))
    said = [("same sources", 0, wr.unchanged(t.spark, path, rd.content_hash(t.spark, source))), ("other sources", 0, wr.unchanged(t.spark, path, "x")), ("nothing there", 0, wr.unchanged(t.spark, path + "-none", digest))]
    return rows.unionByName(t.spark.createDataFrame(said, "step string, rows long, kept boolean"))


@query(f"WITH {ASKED}, {INDEX} SELECT query_id, doc_id, round(score, 6) AS score, rank::INT AS rank FROM lex WHERE rank <= 10")
def k3_stored_index(t):
    """An index written, read back and searched in the partitions of the questions' terms: K3, K4, S18."""
    path = scratch(t.spark, "index")
    save_index(build_index(_docs(t), "doc_id", "text", keep=True), path)
    found = search(load_index(t.spark, path), _asked(t), "query_id", "text", 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


# ---------------------------------------------------------------- answers, prompts, citations


def _quoted(t) -> DataFrame:
    rows = _keyed(_bsb(t)).select("row_id", "ref", tx.collapse(F.regexp_replace("text", '["()\\[\\]`*]', "")).alias("said"))
    return rows.filter("said <> ''")


QUOTED = f"""{BSB}, q AS (SELECT row_id, book || ' ' || chapter || ':' || verse AS ref, trim(regexp_replace(regexp_replace(text, '["()\\[\\]`*]', '', 'g'), '\\s+', ' ', 'g')) AS said FROM bsb)"""
HEAD = an.WORDS_HEAD


@query(f"""WITH {QUOTED} SELECT row_id, '- **' || ref || '**' || chr(10) || chr(10) || '{HEAD}' || chr(10) || '- `word` (note)' || chr(10) || '- Greek: x (G12; ks)' || chr(10) || '  Meaning: said' || chr(10) || '- "' || said || '"' || chr(10) || '- plain (kept)' AS tidy FROM q WHERE said <> ''""")
def f34_tidy_answers(t):
    raw = F.concat(F.lit("  Reference: "), "ref", F.lit("\r\n\n\n\n- **Original key words:**\n- [word]  (note)\n`orig|x|ks|G12|said`\norig|broken\n- \""), "said", F.lit('"\n- plain (kept)\n\n'))
    return _quoted(t).select("row_id", an.tidy_answer(raw).alias("tidy"))


@query(
    f"""WITH {QUOTED} SELECT row_id, 'Said ' || said || chr(10) || chr(10) || '- **' || ref || ' (BSB)**' || chr(10) || chr(10) || '- **' || ref || '**' || chr(10) || '{HEAD}' || chr(10) || '- Hebrew: w (H1; t)' || chr(10) || '  Meaning: day' AS tidy FROM q WHERE said <> ''"""
)
def f34_answers_with_verses(t):
    word = F.array(F.struct(F.lit("w").alias("word"), F.lit("H1").alias("strongs"), F.lit("- day").alias("gloss"), F.lit(None).cast("string").alias("morph"), F.lit("t").alias("transliteration")))
    verses = F.array(F.struct(F.col("ref").alias("reference"), F.lit("BSB").alias("translation"), word.alias("original")))
    return _quoted(t).select("row_id", an.tidy_answer(F.concat(F.lit("Said "), "said"), verses).alias("tidy"))


@query(f"WITH {QUOTED} SELECT row_id, 'Before ' || said AS before, 'After' || chr(10) || 'All quotes from BSB' AS after, 'Before ' || said || ' After' AS summary FROM q WHERE said <> ''")
def f35_sections(t):
    content = F.concat(F.lit("Before "), "said", F.lit('\n- "'), "said", F.lit('"\n- Hebrew: x\n  sub\n- **Next**\n* not text\n\nAfter\nAll quotes from BSB\n'))
    return _quoted(t).select("row_id", an.sections(content).alias("s"), an.summary(content).alias("summary")).select("row_id", "s.before", "s.after", "summary")


@query(f"WITH {QUOTED} SELECT row_id, [ref, 'JHN 1:1'] AS refs, [said, 'In the beginning'] AS texts, ['No original-language tagging available for this verse.', 'λόγος (logos, Strong''s G3056 - word)'] AS words FROM q WHERE said <> ''")
def f40_prompt_verses(t):
    none = F.lit(None).cast(WORDS)
    word = F.array(F.struct(F.lit("λόγος").alias("word"), F.lit("G3056").alias("strongs"), F.lit("word").alias("gloss"), F.lit(None).cast("string").alias("morph"), F.lit("logos").alias("transliteration")))
    prompt = F.concat(an.render_verse(F.col("ref"), F.lit("BSB"), F.col("said"), none), an.render_verse(F.lit("JHN 1:1"), F.lit("BSB"), F.lit("In the beginning"), word))
    found = _quoted(t).select("row_id", an.prompt_verses(prompt).alias("v"))
    return found.select("row_id", F.transform("v", lambda v: v["reference"]).alias("refs"), F.transform("v", lambda v: v["text"]).alias("texts"), F.flatten(F.transform("v", lambda v: v["original"])).alias("words"))


@query(f"""WITH {QUOTED} SELECT row_id, 'See (' || ref || ') and. Also, plain.' AS text, ['MAT 99:99', 'JHN 88:8'] AS removed FROM q WHERE said <> ''""")
def f33_scrubbed_answers(t):
    rows = _quoted(t).select("row_id", "ref", F.concat(F.lit("See ("), "ref", F.lit(") and [MAT 99:99]. Also JHN 88:8 , plain (see MAT 99:99).")).alias("text"))
    out = ci.scrub_answers(rows.select("row_id", "text"), rows, "row_id", "text", "ref")
    return out.select("row_id", "text", "removed")


@query(
    f"""WITH {BSB}, {CODES} SELECT row_id, book || ' ' || chapter || ':' || verse AS reference, coalesce(nullif(trim(tr), ''), 'WEB') AS translation, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM bsb WHERE trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''"""
)
def f38_verse_rows(t):
    """Structured verses, rows without a reference or text left out: F37, F38, P17."""
    row = an.verse_row(F.col("ref"), F.col("tr"), F.lit("WEB"), F.col("text"), F.lit(None).cast(WORDS))
    return _keyed(_bsb(t)).select("row_id", row.alias("v")).filter("v is not null").select("row_id", "v.reference", "v.translation", "v.text")


@query(
    """SELECT word_id, CASE WHEN trim(coalesce(w, '')) <> '' AND trim(coalesce(s, '')) <> '' AND length(trim(regexp_replace(coalesce(g, ''), '\\s+', ' ', 'g'))) >= 2 AND lower(trim(regexp_replace(coalesce(g, ''), '\\s+', ' ', 'g'))) NOT IN ('and', 'the', 'of', 'to')
    THEN 1 ELSE 0 END AS entries FROM gloss_words WHERE NOT regexp_matches(coalesce(g, ''), '(?i)morph:|^[-:;,.]')"""
)
def f37_word_entries(t):
    rows = t("gloss_words").filter(~F.rlike(F.coalesce("g", F.lit("")), F.lit("(?i)morph:|^[-:;,.]")))
    word = F.struct(F.col("w").alias("word"), F.col("s").alias("strongs"), F.col("g").alias("gloss"), F.col("tr").alias("transliteration"))
    return rows.select("word_id", F.size(an.word_entries(F.array(word, word))).alias("entries"))


@query(
    """WITH o AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WHERE event_type IN ('click', 'view', 'purchase')),
    last AS (SELECT user_id, max(struct_pack(ts := ts, e := event_id)) AS l FROM o WHERE event_type = 'click' GROUP BY 1)
    SELECT last.user_id, (l.e || '')::VARCHAR || coalesce(chr(10) || chr(10) || 'CONVERSATION HISTORY' || chr(10) || string_agg(CASE WHEN event_type = 'view' THEN 'Assistant: ' ELSE 'User: ' END || event_id, chr(10) ORDER BY ts, event_id) FILTER (event_type <> 'purchase'), '') AS prompt
    FROM last LEFT JOIN o ON o.user_id = last.user_id AND (o.ts, o.event_id) < (l.ts, l.e) GROUP BY last.user_id, l"""
)
def f49_history(t):
    """The last message of each user with what was said before it: P12, P13, F49. Events stand for messages."""
    role = F.when(F.col("event_type") == "click", "user").when(F.col("event_type") == "view", "assistant").when(F.col("event_type") == "purchase", "system")
    rows = t("events").withColumn("role", role).filter("role is not null").withColumn("content", an.flatten_parts(F.lit(None).cast("string"), F.array(F.struct(F.lit("text").alias("type"), F.col("event_id").cast("string").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")))))
    last = rows.filter("role = 'user'").groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("l"), F.max_by("content", F.struct("ts", "event_id")).alias("asked"))
    before = rows.join(last, "user_id").filter(F.struct("ts", "event_id") < F.col("l")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "role", "content"))).alias("history"))
    both = last.join(before, "user_id", "left")
    history = F.coalesce("history", F.array().cast(before.schema["history"].dataType))
    return both.select("user_id", an.history_prompt(F.col("asked"), history).alias("prompt"))


@query(
    f"""WITH {CODES}, v AS (SELECT row_id, upper(trim(book)) AS book, chapter, verse FROM verses)
    SELECT row_id, ['Using fallback model: m due to rate limits / availability' || chr(10) || chr(10) || 'x', 'x'] AS banner, row_id % 2 = 0 AS quota, CASE WHEN chapter < 256 THEN '10.0.0.' || chapter END AS address, list_distinct([verse, chapter]) IS NOT NULL AS sorted FROM v"""
)
def f36_small_functions(t):
    """F28, F36, F41, F43 on every verse row."""
    content = F.array(an.with_banner(F.lit("x"), F.lit("m"), F.lit(True), F.lit(False)), an.with_banner(F.lit("x"), F.lit("m"), F.lit(False), F.lit(False)))
    quota = an.is_quota_error(F.when(F.col("row_id") % 2 == 0, F.lit(429)), F.lit("no"))
    address = tx.client_address(F.concat(F.lit("::ffff:10.0.0."), "chapter", F.lit(", 1.1.1.1")))
    ordered = tx.sorted_unique(F.array("verse", "chapter", "verse"))
    return t("verses").select("row_id", content.alias("banner"), quota.alias("quota"), address.alias("address"), (F.try_element_at(ordered, F.lit(1)) <= F.try_element_at(ordered, F.lit(-1))).alias("sorted"))


@query(f"WITH {CODES}, names(code, name) AS (VALUES {', '.join(f'({chr(39)}{c}{chr(39)}, {chr(39)}{n}{chr(39)})' for c, n in zip(refs.BOOK_CODES, refs.BOOK_NAMES, strict=True))}) SELECT doc_id, CASE WHEN name IS NULL THEN [trim(primary_ref)] ELSE [name || regexp_extract(trim(primary_ref), '(\\s+.*)$', 1)] END AS allowed FROM documents LEFT JOIN names ON code = upper(split_part(trim(primary_ref), ' ', 1)) WHERE primary_ref IS NOT NULL")
def f30_whitelists(t):
    return t("documents").filter("primary_ref is not null").select("doc_id", ci.whitelist(F.array("primary_ref", "primary_ref", F.lit(" "))).alias("allowed"))


# ---------------------------------------------------------------- nested values, orders, ranges


@query("WITH t AS (SELECT row_id, unnest([x FOR x IN string_split_regex(regexp_replace(lower(text), '[^\\w\\s]', ' ', 'g'), '\\s+') IF x <> '']) AS term FROM verses WHERE text IS NOT NULL) SELECT row_id, term, count(*) AS n FROM t GROUP BY 1, 2")
def a3_map_entries(t):
    """Word counts of every verse as a map, and its entries as rows again."""
    words = t("verses").filter("text is not null").select("row_id", F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("row_id", "term").agg(F.count("*").alias("n"))
    maps = words.groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("counts"))
    return maps.select("row_id", F.explode(F.map_entries("counts")).alias("e")).select("row_id", F.col("e.key").alias("term"), F.col("e.value").alias("n"))


@query(f"WITH {BSB} SELECT doc_id, b.text FROM documents LEFT JOIN bsb b ON upper(split_part(primary_ref, ' ', 1)) = b.book AND split_part(split_part(primary_ref, ' ', 2), ':', 1)::INT = b.chapter AND split_part(primary_ref, ':', 2)::INT = b.verse")
def a4_nested_lookups(t):
    """The verse that a document discusses, looked up in its book's map of chapters and verses where there is one."""
    chapters = _bsb(t).groupBy("book", "chapter").agg(F.map_from_entries(F.collect_list(F.struct("verse", "text"))).alias("verses"))
    books = chapters.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("chapter", "verses"))).alias("chapters"))
    at = refs.parse_verse(F.col("primary_ref"))
    rows = t("documents").select("doc_id", at.alias("at")).withColumn("book", F.col("at")["book"]).join(books, "book", "left")
    return rows.select("doc_id", F.try_element_at(F.try_element_at("chapters", F.col("at")["chapter"]), F.col("at")["verse"]).alias("text"))


@query("SELECT passage_id, verse_ids, len(embedding)::INT AS size FROM passage_windows")
def n1_json_round_trip(t):
    kind = "struct<verse_ids array<string>, embedding array<float>>"
    text = t("passage_windows").select("passage_id", F.to_json(F.struct("verse_ids", "embedding"), {"ignoreNullFields": "false"}).alias("body"))
    back = text.select("passage_id", F.from_json("body", kind, {"allowNonNumericNumbers": "true"}).alias("b"))
    return back.select("passage_id", "b.verse_ids", F.when(F.col("b.embedding").isNotNull(), F.size("b.embedding")).alias("size"))


@query(f"WITH {CHAPTER_RANGES} SELECT passage_id, book || ' ' || chapter || ':' || x AS source, book || ' ' || chapter || ':' || y AS target, hi AS votes FROM k, unnest(range(lo, hi + 1)) AS a(x), unnest(range(lo, hi + 1)) AS b(y)")
def s9_ranges(t):
    """Lines with a range on both sides give every pair: S9, U7, R1, F17."""
    r = _ranges(t)
    dotted = F.concat("book", F.lit("."), "chapter", F.lit("."), "first", F.lit("-"), "book", F.lit("."), "chapter", F.lit("."), "last")
    lines = r.select("key_id", F.concat(dotted, F.lit("\t"), dotted, F.lit("\t"), "last", F.lit("x")).alias("value"))
    parsed = rd.cross_reference_lines(lines.select("value").distinct())
    ends = parsed.join(r.select("key_id", "book", "chapter", F.col("first").alias("lo"), F.col("last").alias("hi")), (F.split_part("source", F.lit(" "), F.lit(1)) == F.col("book")) & (F.split_part(F.split_part("source", F.lit(" "), F.lit(2)), F.lit(":"), F.lit(1)).cast("int") == F.col("chapter")) & (F.col("votes") == F.col("hi")))
    verse = [F.split_part(c, F.lit(":"), F.lit(2)).cast("int") for c in ("source", "target")]
    return ends.filter(verse[0].between(F.col("lo"), F.col("hi")) & verse[1].between(F.col("lo"), F.col("hi"))).select(F.col("key_id").alias("passage_id"), "source", "target", "votes").distinct()


@query("SELECT doc_id, source = 'hymn' AS direct, row_number() OVER (PARTITION BY lang ORDER BY coalesce(source = 'hymn', false) DESC, translate(primary_ref, ':', '.'), doc_id)::INT AS place FROM documents WHERE primary_ref IS NOT NULL")
def t4_direct_first(t):
    """Direct hits first, then references in the order in which they are listed: T3, T4, P15."""
    by = Window.partitionBy("lang").orderBy(F.coalesce(F.col("source") == "hymn", F.lit(False)).desc(), refs.locale_key(F.col("primary_ref")), "doc_id")
    return t("documents").filter("primary_ref is not null").select("doc_id", (F.col("source") == "hymn").alias("direct"), F.row_number().over(by).alias("place"))


@query(f"WITH {BSB} SELECT doc_id FROM documents WHERE primary_ref IN (SELECT book || ' ' || chapter || ':' || verse FROM bsb)")
def j22_prompt_members(t):
    return t("documents").select("doc_id", F.col("primary_ref").alias("ref")).join(_keyed(_bsb(t)).select("ref"), "ref", "left_semi").select("doc_id")


@query(f"WITH {ASKED}, {BOOSTED} SELECT query_id, doc_id, rank::INT AS rank, md5(text) AS digest FROM top JOIN documents USING (doc_id)")
def b18_lexical_fallback(t):
    """The best 25 of the lexical search with their texts."""
    found = search(kept_index(t, "documents", _docs(t), "doc_id", "text"), _asked(t), "query_id", "text", 25, _docs(t))
    return lo.fetch(found, _docs(t), ["doc_id"]).select("query_id", "doc_id", "rank", F.md5("text").alias("digest"))


@query(
    """WITH v AS (SELECT book, chapter, verse, list(c ORDER BY word_id) FILTER (c <> '') AS cs, list(word_pos ORDER BY word_id) FILTER (md = 'particle') AS ps, list(w || '=' || g ORDER BY word_id) FILTER (length(g) > 2 AND w IS NOT NULL) AS gs FROM gloss_words GROUP BY 1, 2, 3)
    SELECT book, chapter, verse, concat_ws(' | ', CASE WHEN len(cs) > 0 THEN 'Clauses: ' || array_to_string([cs[i] FOR i IN range(1, len(cs) + 1) IF list_position(cs, cs[i]) = i], ', ') END, CASE WHEN len(ps) > 0 THEN 'Paragraph break at word(s) ' || array_to_string(ps, ', ') END,
    CASE WHEN len(gs) > 0 THEN 'Glosses: ' || array_to_string(gs[1:3], '; ') END) AS preview FROM v"""
)
def f21_hebrew_preview(t):
    rows = t("gloss_words").groupBy("book", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("word_id", "word_pos", "w", "c", "md", "g"))).alias("l"))
    words = F.transform("l", lambda x: F.struct(x["w"].alias("w"), x["c"].alias("c")))
    breaks = F.transform(F.filter("l", lambda x: x["md"] == "particle"), lambda x: x["word_pos"])
    gloss = F.transform(F.filter("l", lambda x: x["w"].isNotNull()), lambda x: F.struct(x["w"].alias("w"), x["g"].alias("g")))
    none = F.lit(None).cast("array<int>")
    return rows.select("book", "chapter", "verse", hebrew_preview(words, breaks, none, none, gloss).alias("preview"))


# ---------------------------------------------------------------- sequences and rules


@query(
    f"""WITH {BSB}, o AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY chapter DESC, verse) AS n FROM bsb), s AS (SELECT *, coalesce(NOT (chapter = lag(chapter) OVER w AND verse = lag(verse) OVER w + 1), true) AS starts FROM o WINDOW w AS (PARTITION BY book ORDER BY n)),
    r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY book ORDER BY n) AS run FROM s) SELECT book, chapter, min(verse) AS first, max(verse) AS last, md5(trim(regexp_replace(string_agg(text, ' ' ORDER BY n), '\\s+', ' ', 'g'))) AS digest FROM r GROUP BY book, chapter, run"""
)
def w7_normalised_lists(t):
    """Lists of verses, each once at its first place, neighbours merged while they run on: W7."""
    rows = _bsb(t).withColumn("n", F.row_number().over(Window.partitionBy("book").orderBy(F.col("chapter").desc(), "verse")))
    twice = rows.unionByName(rows.withColumn("n", F.col("n") + 1_000_000))
    once = sq.first_wins(twice, ["chapter", "verse"], "n", within=["book"])
    merged = sq.merge_in_order(once, "book", "n", "verse", ["chapter"], "text")
    return merged.select("book", "chapter", "first", "last", F.md5("text").alias("digest"))


@query("SELECT word_id, CASE WHEN coalesce(w, '') = '' OR contains(coalesce(g, ''), coalesce(w, '')) THEN CASE WHEN coalesce(g, '') = '' THEN w ELSE g END WHEN coalesce(g, '') = '' OR contains(w, g) THEN w ELSE w || chr(10) || g END AS merged FROM gloss_words WHERE w IS NOT NULL AND w <> '' AND g IS NOT NULL AND g <> ''")
def w15_merged_texts(t):
    return t("gloss_words").filter("w <> '' and g <> ''").select("word_id", sq.merge_texts(F.array("w", "g", "w")).alias("merged"))
