"""Lookups, sequences, sets, graphs, rules, references, citations and events over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import citations as ci
from corpusmill.functions import questions as qu
from corpusmill.functions import refs
from corpusmill.functions import text as tx
from corpusmill.functions.layers import greek_preview
from corpusmill.functions import morphology as mo
from corpusmill.functions.morphology import describe_morphology
from corpusmill.operators import evaluate as ev
from corpusmill.operators import graph as gr
from corpusmill.operators import lookup as lo
from corpusmill.operators import rules as ru
from corpusmill.operators import sequence as sq
from corpusmill.operators import sets as st
from corpusmill.plans.registry import query
from corpusmill.session import cut_lineage
from corpusmill.sources.readers import cross_reference_lines
from corpusmill.streaming import cache as ca
from corpusmill.streaming import limits as li

TR = "upper(trim(translation))"
#: The latest non-empty load of every verse and translation.
LATEST = f"""latest AS (SELECT row_id, upper(trim(book)) AS book, chapter, verse, text, {TR} AS tr, loaded_at FROM verses WHERE trim(text) <> ''
    QUALIFY row_number() OVER (PARTITION BY upper(trim(book)), chapter, verse, {TR} ORDER BY loaded_at DESC, row_id) = 1)"""
BSB = f"{LATEST}, bsb AS (SELECT * FROM latest WHERE tr = 'BSB')"
EDGES = """edges AS (SELECT DISTINCT edge_id, upper(trim(source.book)) || ' ' || source.chapter || ':' || source.verse AS src,
    upper(trim(target.book)) || ' ' || target.chapter || ':' || target.verse AS dst, votes FROM cross_references WHERE source IS NOT NULL AND target IS NOT NULL)"""
DAY = 86_400_000


def _latest(t) -> DataFrame:
    rows = t("verses").filter(F.length(F.trim("text")) > 0)
    rows = rows.select("row_id", F.upper(F.trim("book")).alias("book"), "chapter", "verse", "text", F.upper(F.trim("translation")).alias("tr"), "loaded_at")
    return lo.unique_rows(rows, ["book", "chapter", "verse", "tr"], F.col("loaded_at").desc(), F.col("row_id"))


def _bsb(t) -> DataFrame:
    return _latest(t).filter("tr = 'BSB'")


def _links(t) -> DataFrame:
    """Every delivery of a link; for operators that take the most votes of a pair, so that repeats don't matter."""
    s, d = F.col("source"), F.col("target")
    rows = t("cross_references").filter(s.isNotNull() & d.isNotNull())
    return rows.select("edge_id", refs.verse_id(s["book"], s["chapter"], s["verse"]).alias("src"), refs.verse_id(d["book"], d["chapter"], d["verse"]).alias("dst"), "votes")


def _edges(t) -> DataFrame:
    return _links(t).distinct()


# ---------------------------------------------------------------- scalar text functions


@query(
    """SELECT row_id, length(regexp_replace(text, '<[^>]+>', '', 'g')) AS n_stripped, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS kebab,
    (regexp_extract_all(lower(text), '\\b([a-z]{4,})\\b', 1))[-2:] AS tail, ceil(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 3.0)::INT AS budget,
    greatest(1, ceil(length(text) / 220.0))::INT AS chunks, sha256('ask' || chr(0) || coalesce(text, '')) AS key FROM verses WHERE text IS NOT NULL"""
)
def f_text_scalars(t):
    text = F.col("text")
    return t("verses").filter("text is not null").select(
        "row_id", F.length(tx.strip_tags(text)).cast("long").alias("n_stripped"), tx.kebab(text).alias("kebab"), tx.last_long_words(text).alias("tail"), tx.token_estimate(text).alias("budget"), F.size(tx.chunks(text)).alias("chunks"), tx.cache_key(F.lit("ask"), text).alias("key")
    )


@query("SELECT word_id, regexp_replace(regexp_replace(w, '[\\x{0591}-\\x{05C7}]', '', 'g'), '[^\\x{0590}-\\x{05FF}]', '', 'g') AS letters FROM gloss_words WHERE w IS NOT NULL")
def f19_hebrew_letters(t):
    return t("gloss_words").filter("w is not null").select("word_id", tx.hebrew_letters(F.col("w")).alias("letters"))


@query(
    """SELECT doc_id, upper(regexp_extract(primary_ref, '^\\s*([1-3]?[A-Za-z]{2,3})\\s+(\\d+):(\\d+)', 1)) AS book, regexp_extract(primary_ref, '(\\d+):(\\d+)', 1)::INT AS chapter,
    regexp_extract(primary_ref, '(\\d+):(\\d+)', 2)::INT AS verse, translate(primary_ref, ':', '.') AS key FROM documents WHERE primary_ref IS NOT NULL"""
)
def f15_parse_reference(t):
    parsed = refs.parse_verse(F.col("primary_ref"))
    return t("documents").filter("primary_ref is not null").select("doc_id", parsed["book"].alias("book"), parsed["chapter"].alias("chapter"), parsed["verse"].alias("verse"), refs.locale_key(F.col("primary_ref")).alias("key"))


@query(
    f"""WITH codes(code, name, ordinal) AS (VALUES {", ".join(f"('{c}', '{n}', {i + 1})" for i, (c, n) in enumerate(zip(refs.BOOK_CODES, refs.BOOK_NAMES, strict=True)))})
    SELECT row_id, upper(trim(book)) AS code, coalesce(name, upper(trim(book))) AS name, ordinal, CASE WHEN ordinal <= 39 THEN 'OT' WHEN ordinal > 39 THEN 'NT' END AS testament FROM verses LEFT JOIN codes ON code = upper(trim(book))"""
)
def f16_book_dimension(t):
    code = F.upper(F.trim("book"))
    return t("verses").select("row_id", refs.book_code(F.col("book")).alias("code"), refs.book_name(code).alias("name"), refs.book_ordinal(code).alias("ordinal"), refs.testament(code).alias("testament"))


ALIASES = "aliases(alias, code) AS (VALUES " + ", ".join(f"('{a}', '{c}')" for a, c in refs.book_aliases().items()) + ")"
IN_TEXT = refs.IN_TEXT.replace("'", "''")


@query(
    f"""WITH {ALIASES}, f AS (SELECT doc_id, {", ".join(f"regexp_extract_all(text, '{IN_TEXT}', {g}) AS g{g}" for g in (1, 2, 3, 4))} FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, unnest(range(len(g1))) AS pos, unnest(g1) AS b, unnest(g2) AS c, unnest(g3)::INT AS v, try_cast(unnest(g4) AS INT) AS w FROM f),
    k AS (SELECT doc_id, pos, code || ' ' || c::INT || ':' || unnest(range(v, greatest(v, coalesce(w, v)) + 1)) AS verse, unnest(range(v, greatest(v, coalesce(w, v)) + 1)) AS n FROM r JOIN aliases ON alias = upper(regexp_replace(b, '[\\s.]+', '', 'g'))),
    o AS (SELECT doc_id, verse, min(struct_pack(p := pos, n := n)) AS first FROM k GROUP BY 1, 2) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INT AS at, verse FROM o"""
)
def f14_references_in_text(t):
    rows = t("documents").select("doc_id", refs.references_in(F.col("text")).alias("found"))
    return rows.select("doc_id", F.posexplode(refs.reference_ids(F.col("found"))).alias("at", "verse"))


def _sql_map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


MORPHOLOGY = f"""WITH c AS (SELECT m, count(*) AS n FROM gloss_words WHERE m IS NOT NULL GROUP BY 1), p AS (SELECT m, n, [x FOR x IN string_split(regexp_replace(trim(m), '^[HA]', ''), '/') IF x <> ''] AS parts FROM c)
    SELECT m, n, nullif(array_to_string([x FOR x IN [CASE WHEN left(s, 1) = 'V' THEN array_to_string([y FOR y IN list_concat(['Verb', {_sql_map(mo.STEMS)}[s[2]], {_sql_map(mo.ASPECTS)}[s[3]]], [{_sql_map(mo.STATES | mo.NUMBERS | mo.GENDERS | mo.PERSONS)}[z] FOR z IN string_split(s[4:], '')]) IF y IS NOT NULL], ', ')
    WHEN left(s, 1) IN ('N', 'A', 'P') THEN array_to_string([y FOR y IN list_concat([{_sql_map(mo.LABELS)}[s[1]]], [{_sql_map(mo.STATES | mo.NUMBERS | mo.GENDERS | {"c": "Common", "p": "Proper"})}[z] FOR z IN string_split(s[2:], '')]) IF y IS NOT NULL], ', ')
    WHEN left(s, 1) = 'T' THEN CASE WHEN contains(s, 'd') THEN 'Definite Article' ELSE 'Particle' END ELSE {_sql_map(mo.PLAIN)}[s[1]] END FOR s IN parts] IF x IS NOT NULL], ' / '), '') AS said FROM p"""


@query(MORPHOLOGY)
def f24_morphology(t):
    return t("gloss_words").filter("m is not null").groupBy("m").agg(F.count("*").alias("n")).withColumn("said", describe_morphology(F.col("m")))


def _sql_has(text: str, keyword: str) -> str:
    return f"contains({text}, '{keyword}')" if " " in keyword else f"regexp_matches({text}, '\\b{keyword}\\b')"


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]::VARCHAR[]"


def _sql_additions(domain: str) -> str:
    """The terms of the first rule of a domain whose trigger is in the question, at most two."""
    return "CASE " + " ".join(f"WHEN {_sql_has('low', t)} THEN {_sql_list(added[:2])}" for t, added in qu.EXPANSIONS[domain]) + " ELSE [] END"


def _sql_without_phrases() -> str:
    out = "low"
    for phrase in qu.PHRASES:
        out = f"replace({out}, '{phrase}', ' ')"
    return out


UNDERSTOOD = f"""WITH q AS (SELECT cluster_id, trim(regexp_replace(regexp_replace('What does the Bible say about ' || cluster_label || '?', '(?i)^(?:{"|".join(qu.FILLERS)})\\b[\\s,:-]*', ''), '\\s+', ' ', 'g')) AS normalized FROM tsk_clusters WHERE cluster_label IS NOT NULL),
    d AS (SELECT *, lower(normalized) AS low, CASE {" ".join("WHEN " + " OR ".join(_sql_has("lower(normalized)", k) for k in words) + f" THEN '{name}'" for name, words in qu.DOMAINS)} ELSE 'general' END AS domain FROM q),
    p AS (SELECT *, [x FOR x IN {_sql_list(qu.PHRASES)} IF contains(low, x)] AS phrases FROM d),
    w AS (SELECT *, [x FOR x IN string_split_regex(regexp_replace({_sql_without_phrases()}, '[^a-z0-9_:\\- ]', ' ', 'g'), '\\s+') IF x <> '' AND NOT list_contains({_sql_list(qu.LOW_VALUE)}, x)] AS words FROM p),
    c AS (SELECT *, array_to_string([words[i] FOR i IN range(1, len(words) + 1) IF list_position(words, words[i]) = i], ' ') AS cleaned, ['"' || x || '"' FOR x IN phrases] AS quoted FROM w),
    b AS (SELECT *, list_concat([CASE WHEN cleaned <> '' THEN cleaned WHEN len(phrases) > 0 THEN array_to_string(quoted, ' ') ELSE normalized END], quoted,
        [x FOR x IN CASE domain {" ".join(f"WHEN '{name}' THEN {_sql_additions(name)}" for name in qu.EXPANSIONS)} ELSE [] END IF NOT contains(low, lower(x))]) AS parts FROM c),
    e AS (SELECT *, array_to_string([parts[i] FOR i IN range(1, len(parts) + 1) IF list_position(parts, parts[i]) = i], ' ') AS expanded FROM b),
    s AS (SELECT *, flatten([list_concat([x], coalesce({"MAP {" + ", ".join(f"'{k}': {_sql_list(v[:2])}" for k, v in qu.SYNONYMS.items()) + "}"}[x], [])) FOR x IN string_split_regex(lower(expanded), '\\s+')]) AS found FROM e),
    f AS (SELECT *, list_concat(found, {", ".join(f"CASE WHEN contains(lower(expanded), '{phrase}') AND NOT list_contains(found, '{mark}') THEN {_sql_list(added[:2])} ELSE [] END" for phrase, added, mark in qu.PHRASE_SYNONYMS)}) AS every FROM s)
    SELECT cluster_id, domain, 'TOPICAL_QUERY' AS intent, normalized, expanded, array_to_string([every[i] FOR i IN range(1, len(every) + 1) IF list_position(every, every[i]) = i], ' ') AS searched FROM f"""


@query(UNDERSTOOD)
def f13_understand(t):
    asked = t("tsk_clusters").filter("cluster_label is not null").select("cluster_id", F.concat(F.lit("What does the Bible say about "), "cluster_label", F.lit("?")).alias("question"))
    return qu.understand(asked, "question").select("cluster_id", "domain", "intent", "normalized", "expanded", qu.add_synonyms(F.col("expanded"), F.size("negations") > 0, 2).alias("searched"))


@query("SELECT doc_id, text LIKE '%covenant%' OR lower(text) LIKE '%covenant%' AS part, regexp_matches(lower(text), '\\bking\\b') AS word, contains(lower(text), 'the river') AS phrase FROM documents WHERE text IS NOT NULL")
def p1_keyword_predicates(t):
    text = F.col("text")
    return t("documents").filter("text is not null").select("doc_id", tx.contains_any(text, ["covenant"]).alias("part"), tx.has_keyword(text, "king").alias("word"), tx.has_keyword(text, "the river").alias("phrase"))


@query("SELECT passage_id, round(greatest(0.01, 1 - (row_number() OVER (ORDER BY passage_id) - 1) / count(*) OVER ()::DOUBLE), 6) AS score FROM (SELECT passage_id FROM passage_windows WHERE contains(lower(text), 'spake') ORDER BY passage_id LIMIT 10)")
def p4_passage_scan(t):
    found = t("passage_windows").filter(F.contains(F.lower("text"), F.lit("spake"))).select("passage_id").orderBy("passage_id").limit(10)
    n = F.count("*").over(Window.partitionBy())  # ten rows
    place = F.row_number().over(Window.orderBy("passage_id"))
    return found.select("passage_id", F.round(F.greatest(F.lit(0.01), 1 - (place - 1) / n), 6).alias("score"))


@query("SELECT cluster_id, vote_total FROM tsk_clusters WHERE len([w FOR w IN ['covenant', 'vine', 'judge', 'night'] IF contains(lower(cluster_label), w)]) > 0 ORDER BY vote_total DESC NULLS LAST, cluster_id LIMIT 8")
def p5_cluster_scan(t):
    hit = tx.contains_any(F.col("cluster_label"), ["covenant", "vine", "judge", "night"])
    return t("tsk_clusters").filter(hit).select("cluster_id", "vote_total").orderBy(F.col("vote_total").desc_nulls_last(), "cluster_id").limit(8)


@query(f"WITH {EDGES} SELECT edge_id, votes FROM edges WHERE coalesce(votes, 0) > 10")
def p9_votes_filter(t):
    return _edges(t).filter(gr.votes_above(F.col("votes"))).select("edge_id", "votes")


@query("SELECT json_extract(props, '$.k')::BIGINT % 10 AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def n1_json_fields(t):
    k = F.from_json("props", "k long")["k"]
    return t("events").groupBy((k % 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ---------------------------------------------------------------- joins and lookups


@query(f"WITH {BSB} SELECT doc_id, b.row_id, b.text FROM documents d JOIN bsb b ON d.primary_ref = b.book || ' ' || b.chapter || ':' || b.verse")
def j1_fetch_by_reference(t):
    keys = t("documents").select("doc_id", F.col("primary_ref").alias("ref")).filter("ref is not null")
    rows = _bsb(t).select(refs.verse_id(F.col("book"), F.col("chapter"), F.col("verse")).alias("ref"), "row_id", "text")
    return lo.fetch(keys, rows, ["ref"]).select("doc_id", "row_id", "text")


@query(
    f"""WITH {LATEST}, k AS (SELECT DISTINCT book, chapter, verse FROM latest), o AS (SELECT k.*, a.text AS ta, b.text AS tb, c.text AS tc FROM k
    LEFT JOIN latest a ON a.tr = 'BSB' AND a.book = k.book AND a.chapter = k.chapter AND a.verse = k.verse LEFT JOIN latest b ON b.tr = 'KJV' AND b.book = k.book AND b.chapter = k.chapter AND b.verse = k.verse
    LEFT JOIN latest c ON c.tr = 'WEB' AND c.book = k.book AND c.chapter = k.chapter AND c.verse = k.verse)
    SELECT book, chapter, verse, coalesce(ta, tb, tc) AS text, CASE WHEN ta IS NOT NULL THEN 1 WHEN tb IS NOT NULL THEN 2 ELSE 3 END AS source FROM o WHERE coalesce(ta, tb, tc) IS NOT NULL"""
)
def j3_fallback_chain(t):
    rows = _latest(t)
    sources = [rows.filter(F.col("tr") == tr).select("book", "chapter", "verse", "text") for tr in ("BSB", "KJV", "WEB")]
    return lo.resolve(rows.select("book", "chapter", "verse").distinct(), sources, ["book", "chapter", "verse"], "text").select("book", "chapter", "verse", "text", "source")


@query(f"""WITH {LATEST} SELECT a.row_id, coalesce(b.text, a.text) AS text, coalesce(b.tr, a.tr) AS tr FROM latest a LEFT JOIN latest b ON b.tr = 'NHEB' AND a.book = b.book AND a.chapter = b.chapter AND a.verse = b.verse WHERE a.tr = 'BSB'""")
def j4_override(t):
    rows = _latest(t)
    return lo.override(rows.filter("tr = 'BSB'"), rows.filter("tr = 'NHEB'"), ["book", "chapter", "verse"], ["text", "tr"]).select("row_id", "text", "tr")


@query(f"WITH {EDGES} SELECT src, dst, max(votes) AS votes, row_number() OVER (PARTITION BY src ORDER BY coalesce(max(votes), 0) DESC, dst)::INT AS place FROM edges GROUP BY 1, 2")
def j6_strongest_links(t):
    return gr.strongest_links(_links(t), "src", "dst", "votes")


@query(
    f"""WITH {EDGES}, p AS (SELECT doc_id, primary_ref AS src FROM documents WHERE primary_ref IS NOT NULL), m AS (SELECT doc_id, dst, max(votes) AS votes FROM p JOIN edges USING (src) WHERE votes > 10 AND src <> dst GROUP BY 1, 2)
    SELECT doc_id, dst, votes, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, dst)::INT AS place FROM m QUALIFY place <= 3"""
)
def j7_expand_links(t):
    primary = t("documents").filter("primary_ref is not null").select("doc_id", "primary_ref")
    return gr.expand_links(primary, _links(t), "doc_id", "primary_ref", "src", "dst", "votes")


WORD_TABLES = """n AS (SELECT *, regexp_replace(regexp_replace(coalesce(w, ''), '[\\x{0591}-\\x{05C7}]', '', 'g'), '[^\\x{0590}-\\x{05FF}]', '', 'g') AS p FROM gloss_words)"""


@query(
    f"""WITH {WORD_TABLES}, l AS (SELECT word_id, book, chapter, verse, s, p, w FROM n WHERE word_id % 2 = 0), r AS (SELECT word_id AS rid, book, chapter, verse, s AS rs, p AS rp, m, w AS rw FROM n WHERE word_id % 2 = 1),
    c AS (SELECT l.word_id, r.m, CASE WHEN s = rs AND w IS NOT NULL AND rw IS NOT NULL AND p = rp THEN 1 WHEN s = rs THEN 2 WHEN w IS NOT NULL AND rw IS NOT NULL AND p = rp THEN 3 END AS rank, rid FROM l JOIN r USING (book, chapter, verse)),
    b AS (SELECT word_id, m FROM c WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY word_id ORDER BY m IS NULL, rank, rid) = 1)
    SELECT l.word_id, b.m AS tag FROM l LEFT JOIN b USING (word_id)"""
)
def j8_match_morphology(t):
    rows = t("gloss_words")
    words = rows.filter("word_id % 2 = 0").select("book", "chapter", "verse", F.col("word_id").alias("ord"), F.col("w").alias("word"), F.col("s").alias("lemma"), F.lit(None).cast("string").alias("tag"))
    tagged = rows.filter("word_id % 2 = 1 and m is not null").select("book", "chapter", "verse", F.col("w").alias("word"), F.col("s").alias("lemma"), F.col("word_id").alias("position"), F.col("m").alias("tag"))
    return lo.match_morphology(words, tagged, ["book", "chapter", "verse"], "word", "lemma", "position", "tag").select(F.col("ord").alias("word_id"), "tag")


@query(
    """WITH lex AS (SELECT upper(trim(s)) AS id, arg_min(g, word_id) AS g, arg_min(tr, word_id) AS tr FROM gloss_words WHERE s IS NOT NULL AND g IS NOT NULL AND tr IS NOT NULL GROUP BY 1)
    SELECT word_id, lex.g AS gloss, lex.tr AS transliteration FROM gloss_words w LEFT JOIN lex ON upper(trim(w.s)) = lex.id"""
)
def j9_lexicon(t):
    rows = t("gloss_words")
    first = rows.filter("s is not null and g is not null and tr is not null").withColumn("lemma_id", F.upper(F.trim("s"))).groupBy("lemma_id").agg(F.min_by(F.struct("g", "tr"), "word_id").alias("e"))
    lexicon = first.select("lemma_id", F.col("e.g").alias("short_definition"), F.lit("").alias("definition"), F.col("e.tr").alias("transliteration"))
    return lo.gloss_from_lexicon(rows.select("word_id", "s"), lexicon, "s").select("word_id", "gloss", "transliteration")


@query(
    """WITH v AS (SELECT book, chapter, verse, list(w || '=' || i ORDER BY word_pos, word_id) FILTER (w IS NOT NULL AND i IS NOT NULL AND i <> '') AS l FROM greek_interlinear GROUP BY 1, 2, 3)
    SELECT book, chapter, verse, CASE WHEN len(l) > 0 THEN 'Interlinear: ' || array_to_string(l[1:4], '; ') ELSE '' END AS preview FROM v"""
)
def j10_layer_preview(t):
    words = t("greek_interlinear").groupBy("book", "chapter", "verse").agg(F.array_sort(F.collect_list(F.struct("word_pos", "word_id", "w", "i"))).alias("words"))
    none = F.lit(None)
    kept = F.filter("words", lambda x: x["w"].isNotNull())
    preview = greek_preview(none.cast("array<struct<w:string,s:string,r:string>>"), kept, none.cast("array<string>"), none.cast("map<string,string>"))
    return words.select("book", "chapter", "verse", preview.alias("preview"))


@query(
    """SELECT o_orderkey, n_name, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, o_orderpriority) AS label
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def j15_layered_join(t):
    base = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    people = t("customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"), F.col("c_nationkey").alias("n_nationkey"))
    rows = lo.join_layers(lo.join_layers(base, [people], ["c_custkey"]), [t("nation").select("n_nationkey", "n_name")], ["n_nationkey"])
    return rows.select("o_orderkey", "n_name", "segment", F.coalesce("segment", "o_orderpriority").alias("label"))


@query("SELECT primary_ref, arg_max(doc_id, written_at) AS doc_id FROM documents WHERE primary_ref IS NOT NULL AND written_at IS NOT NULL GROUP BY 1")
def j18_last_write(t):
    rows = t("documents").filter("primary_ref is not null and written_at is not null")
    return lo.last_write(rows.select(F.col("primary_ref"), F.col("doc_id"), "written_at"), "primary_ref", "doc_id", "written_at")


@query(f"""WITH {LATEST} SELECT v.row_id, CASE WHEN coalesce(trim(v.text), '') = '' THEN coalesce(nullif(trim(k.text), ''), v.text) ELSE v.text END AS text, coalesce(trim(v.text), '') = '' AND k.text IS NOT NULL AS repaired
    FROM verses v LEFT JOIN latest k ON k.tr = 'KJV' AND upper(trim(v.book)) = k.book AND v.chapter = k.chapter AND v.verse = k.verse""")
def j19_repair(t):
    rows = t("verses").select("row_id", F.upper(F.trim("book")).alias("book"), "chapter", "verse", "text")
    return lo.repair(rows, _latest(t).filter("tr = 'KJV'"), ["book", "chapter", "verse"], "text").select("row_id", "text", "repaired")


@query(
    """WITH k AS (SELECT DISTINCT user_id, unnest([1, 2, 3]) AS ord FROM events), c AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 END AS ord, arg_max(props, event_id) AS value FROM events GROUP BY 1, 2)
    SELECT user_id, arg_min(ord, ord)::INT AS ord, arg_min(value, ord) AS value FROM k JOIN c USING (user_id, ord) GROUP BY 1"""
)
def j21_first_cached(t):
    rows = t("events")
    keys = rows.select("user_id").distinct().withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("key", F.concat_ws("-", "user_id", "ord"))
    number = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "click", 3)
    cache = rows.withColumn("key", F.concat_ws("-", "user_id", number)).filter(number.isNotNull()).groupBy("key").agg(F.max_by("props", "event_id").alias("value"))
    best = lo.first_cached(keys, cache, "user_id", "ord", "key", "value")
    return best.select("user_id", F.substring_index("key", "-", -1).cast("int").alias("ord"), "value")


# ---------------------------------------------------------------- sequences


@query("SELECT row_id FROM verses QUALIFY row_number() OVER (PARTITION BY book, chapter, verse, text, translation, dataset_version ORDER BY row_id) = 1")
def w1_delete_duplicates(t):
    return sq.first_wins(t("verses"), ["book", "chapter", "verse", "text", "translation", "dataset_version"], "row_id").select("row_id")


@query(
    f"""WITH {BSB} SELECT row_id, list(book || ' ' || chapter || ':' || verse) OVER w AS ids, md5(array_to_string(list(text) OVER w, ' ')) AS digest FROM bsb WINDOW w AS (PARTITION BY book, chapter ORDER BY verse ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def w3_passage_windows(t):
    rows = _bsb(t).withColumn("id", refs.verse_id(F.col("book"), F.col("chapter"), F.col("verse")))
    return sq.frames(rows, ["book", "chapter"], "verse", "id", "text").select("row_id", F.col("window_ids").alias("ids"), F.md5("window_text").alias("digest"))


@query(
    f"""WITH {BSB}, k AS (SELECT DISTINCT upper(split_part(primary_ref, ' ', 1)) AS book, split_part(split_part(primary_ref, ' ', 2), ':', 1)::INT AS chapter, split_part(primary_ref, ':', 2)::INT AS verse FROM documents WHERE primary_ref IS NOT NULL),
    e AS (SELECT DISTINCT book, chapter, verse + d AS verse FROM k, (SELECT unnest([-1, 0, 1]) AS d) WHERE verse + d >= 1) SELECT b.row_id FROM e JOIN bsb b USING (book, chapter, verse)"""
)
def w4_neighbours(t):
    at = refs.parse_verse(F.col("primary_ref"))
    keys = t("documents").select(at["book"].alias("book"), at["chapter"].alias("chapter"), at["verse"].alias("verse"), F.col("doc_id").alias("ord")).filter("book is not null")
    return sq.neighbours(keys, _bsb(t), ["book", "chapter"], "verse").select("row_id")


RUNS = """i AS (SELECT book, chapter, verse, text, verse - row_number() OVER (PARTITION BY book, chapter ORDER BY verse) AS g FROM bsb)"""


@query(f"""WITH {BSB}, {RUNS} SELECT book, chapter, min(verse) AS first, max(verse) AS last, count(*) AS rows, md5(trim(regexp_replace(string_agg(text, ' ' ORDER BY verse), '\\s+', ' ', 'g'))) AS digest FROM i GROUP BY book, chapter, g""")
def w5_merge_runs(t):
    merged = sq.merge_runs(_bsb(t), ["book", "chapter"], "verse", "text")
    return merged.select("book", "chapter", "first", "last", "rows", F.md5("text").alias("digest"))


@query("SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY text")
def w6_first_wins(t):
    return sq.first_wins(t("documents").filter("text is not null"), ["text"], "doc_id").select("doc_id")


@query(
    """WITH s AS (SELECT doc_id, source, coalesce(ceil(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) / 3.0)::INT, 0) AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
    u AS (SELECT *, sum(tokens) OVER w AS used FROM s WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))
    SELECT doc_id, source, tokens, used::BIGINT AS used FROM u QUALIFY NOT bool_or(used > 1500 AND n > 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"""
)
def w8_prefix_budget(t):
    return sq.prefix_budget(t("documents"), ["source"], ["doc_id"], "text", 1500).select("doc_id", "source", "tokens", "used")


#: An ordered fold: the first kept entry that the condition holds for takes the new one in, else it is kept itself.
FOLD = """list_reduce(l, lambda x, y: CASE WHEN list_position([{met} FOR k IN x], true) IS NULL THEN list_concat(x, y) ELSE [CASE WHEN i = list_position([{met} FOR k IN x], true) THEN {joined} ELSE x[i] END FOR i IN range(1, len(x) + 1)] END)"""
OVERLAP = "(len(list_intersect(k.ids, y[1].ids)) / greatest(1, len(list_distinct(k.ids)), len(list_distinct(y[1].ids)))::DOUBLE > 0.6)"


@query(
    f"""WITH p AS (SELECT split_part(anchor_verse, ':', 1) AS chapter, passage_id, verse_ids AS ids, len(verse_ids)::DOUBLE AS score FROM passage_windows WHERE anchor_verse IS NOT NULL),
    g AS (SELECT chapter, list([struct_pack(ids := ids, score := score)] ORDER BY passage_id) AS l FROM p GROUP BY 1),
    m AS (SELECT chapter, {FOLD.format(met=OVERLAP, joined="struct_pack(ids := CASE WHEN len(y[1].ids) > len(x[i].ids) THEN y[1].ids ELSE x[i].ids END, score := greatest(x[i].score, y[1].score))")} AS kept FROM g),
    u AS (SELECT chapter, unnest(kept) AS k, unnest(range(len(kept))) AS pos FROM m) SELECT chapter, k.ids AS verse_ids, k.score AS score, row_number() OVER (PARTITION BY chapter ORDER BY k.score DESC, pos)::INT AS rank FROM u"""
)
def w9_merge_overlapping(t):
    rows = t("passage_windows").select(F.substring_index("anchor_verse", ":", 1).alias("chapter"), "passage_id", "verse_ids", F.size("verse_ids").cast("double").alias("score")).filter("chapter is not null")
    return sq.merge_overlapping(rows, "chapter", "passage_id", "verse_ids", "score")


@query(
    f"""WITH p AS (SELECT upper(split_part(anchor_verse, ' ', 1)) AS book, split_part(split_part(anchor_verse, ' ', 2), ':', 1)::INT AS chapter, split_part(anchor_verse, ':', 2)::INT AS verse, anchor_verse AS who, verse_ids AS ids FROM passage_windows WHERE anchor_verse IS NOT NULL),
    g AS (SELECT book, chapter, list([struct_pack(who := who, ids := ids)] ORDER BY verse) AS l FROM p GROUP BY 1, 2),
    m AS (SELECT book, chapter, {FOLD.format(met=f"({OVERLAP} AND (list_contains(k.ids, y[1].who) OR list_contains(y[1].ids, k.who)))", joined="struct_pack(who := x[i].who, ids := list_concat(x[i].ids, [v FOR v IN y[1].ids IF NOT list_contains(x[i].ids, v)]))")} AS kept FROM g)
    SELECT book, chapter, unnest(kept).ids AS verse_ids FROM m"""
)
def w10_merge_windows(t):
    at = refs.parse_verse(F.col("anchor_verse"))
    rows = t("passage_windows").select(at["book"].alias("book"), at["chapter"].alias("chapter"), at["verse"].alias("verse"), "anchor_verse", "verse_ids").filter("book is not null")
    return sq.merge_windows(rows, ["book", "chapter"], "verse", "anchor_verse", "verse_ids")


@query("SELECT word_id, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY word_pos, word_id)::INT AS at FROM gloss_words")
def w11_position_in_verse(t):
    return sq.numbered_within(t("gloss_words"), ["book", "chapter", "verse"], "word_pos", "word_id").select("word_id", "at")


@query("WITH n AS (SELECT book, chapter, verse, md, row_number() OVER (PARTITION BY book, chapter, verse ORDER BY word_id)::INT AS pos FROM gloss_words) SELECT book, chapter, verse, list(pos ORDER BY pos) AS places FROM n WHERE md = 'particle' GROUP BY 1, 2, 3")
def w12_marked_places(t):
    return sq.marked_places(t("gloss_words"), ["book", "chapter", "verse"], "word_id", F.col("md") == "particle")


TAGS = [("royal", "king", 0.9), ("royal", "crown", 0.7), ("pastoral", "shepherd", 0.8), ("pastoral", "flock", 0.6), ("legal", "judgment", 0.9), ("legal", "judge", 0.5), ("promise", "covenant", 1.0), ("faint", "river", 0.3), ("household", "bread", 0.55)]
TAG_TABLE = "tags(topic_id, keyword, confidence) AS (VALUES " + ", ".join(f"('{i}', '{k}', {c}::DOUBLE)" for i, k, c in TAGS) + ")"
TAGGED = f"""{TAG_TABLE}, m AS (SELECT doc_id, topic_id, max(confidence) AS confidence FROM documents, tags WHERE regexp_matches(lower(text), '\\b' || keyword || '\\b') GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, topic_id)::INT AS place FROM m WHERE confidence >= 0.4 QUALIFY place <= 3)"""


def _tags(t) -> DataFrame:
    rules = t.spark.createDataFrame(TAGS, "topic_id string, keyword string, confidence double")
    return ru.tag_rows(t("documents"), rules, "doc_id", "text")


@query(f"WITH {TAGGED} SELECT doc_id, topic_id, confidence, place FROM top")
def w13_top_topics(t):
    return _tags(t)


@query(f"WITH {TAGGED} SELECT DISTINCT topic_id, doc_id FROM top")
def g21_items_of_topics(t):
    return ru.items_of_topics(_tags(t), "doc_id")


@query(f"WITH {TAGGED}, c AS (SELECT source, topic_id, count(*) AS n FROM top JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT source, topic_id FROM c WHERE source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, topic_id) = 1")
def g8_most_frequent_topic(t):
    return gr.most_frequent(_tags(t).join(t("documents").select("doc_id", "source"), "doc_id").filter("source is not null"), "source", "topic_id")


@query(
    """SELECT doc_id, list_filter([CASE WHEN regexp_matches(lower(text), '\\b(king|crown)\\b') THEN 'royal' END, CASE WHEN regexp_matches(lower(text), '\\b(shepherd|flock)\\b') THEN 'pastoral' END,
    CASE WHEN contains(lower(text), 'the river') THEN 'water' END], lambda x: x IS NOT NULL) AS tags FROM documents WHERE text IS NOT NULL"""
)
def p21_tag_array(t):
    tags = ru.tag_array(F.col("text"), [("royal", ["king", "crown"]), ("pastoral", ["shepherd", "flock"]), ("water", ["the river"])])
    return t("documents").filter("text is not null").select("doc_id", tags.alias("tags"))


@query(
    """WITH a AS (SELECT user_id, event_id AS item, 0 AS l, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS o FROM events WHERE event_type = 'purchase'),
    b AS (SELECT user_id, event_id AS item, 1 AS l, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS o FROM events),
    u AS (SELECT user_id, item, min(struct_pack(l := l, o := o)) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
    SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY k)::INT AS place FROM u QUALIFY place <= 8"""
)
def w16_interleave(t):
    rows = t("events").withColumnRenamed("event_id", "item")
    first = rows.filter("event_type = 'purchase'").withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("value").desc(), "item")))
    second = rows.withColumn("o", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))
    return sq.interleave([first.select("user_id", "item", "o"), second.select("user_id", "item", "o")], "user_id", "item", "o", 8)


@query(f"WITH {BSB} SELECT book, chapter, md5(string_agg(text, ' ' ORDER BY verse)) AS digest, book || '.' || chapter || '.' || min(verse) || '-' || chapter || '.' || max(verse) AS passage_id FROM bsb GROUP BY 1, 2")
def g20_chapter_texts(t):
    rows = _bsb(t).withColumn("id", refs.verse_id(F.col("book"), F.col("chapter"), F.col("verse")))
    sorted_ = F.array_sort(F.collect_list(F.struct("verse", "text", "id")))
    out = rows.groupBy("book", "chapter").agg(sorted_.alias("v"))
    return out.select("book", "chapter", F.md5(F.array_join(F.transform("v", lambda x: x["text"]), " ")).alias("digest"), refs.passage_id(F.transform("v", lambda x: x["id"])).alias("passage_id"))


# ---------------------------------------------------------------- sets and upserts


@query("SELECT coalesce(min(CASE WHEN lower(trim(source)) = 'hymn' THEN doc_id END), min(doc_id)) AS doc_id FROM documents WHERE primary_ref IS NOT NULL GROUP BY primary_ref")
def u1_append_distinct(t):
    """Hymns first, then all other documents, each verse once."""
    rows = t("documents").filter("primary_ref is not null").select("doc_id", "primary_ref", F.coalesce(F.lower(F.trim("source")) == "hymn", F.lit(False)).alias("hymn"))
    return st.append_distinct(rows.filter("hymn"), rows.filter("not hymn"), [F.col("primary_ref")], "doc_id").select("doc_id")


@query(
    """WITH base AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS prio FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01'),
    inc AS (SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, CASE WHEN o_orderstatus <> 'O' THEN 'NEW' END AS prio FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')
    SELECT coalesce(i.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN i.o_orderkey IS NOT NULL THEN i.o_totalprice ELSE b.o_totalprice END AS o_totalprice, coalesce(i.prio, b.prio) AS prio FROM base b FULL JOIN inc i USING (o_orderkey)"""
)
def k5_upsert(t):
    """Orders before 2000 exist, those from 1998 on come in: every order is on one side or both."""
    rows, day = t("orders"), F.col("o_orderdate")
    base = rows.filter(day < F.lit("2000-01-01").cast("timestamp")).select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("prio"))
    new = rows.filter(day >= F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.when(F.col("o_orderstatus") != "O", F.lit("NEW")).alias("prio"))
    return st.upsert(base, new, ["o_orderkey"], ["o_totalprice"], ["prio"])


@query("""WITH old AS (SELECT edge_id, votes FROM cross_references WHERE loaded_at < TIMESTAMP '2025-04-01'), new AS (SELECT edge_id, min(votes) AS votes FROM cross_references WHERE loaded_at >= TIMESTAMP '2025-04-01' OR loaded_at IS NULL GROUP BY 1)
    SELECT edge_id, votes FROM old UNION ALL SELECT edge_id, votes FROM new WHERE edge_id NOT IN (SELECT edge_id FROM old)""")
def k6_insert_missing(t):
    """Every link is on one side: those loaded before April exist, the later ones, with their re-deliveries, come in."""
    rows = t("cross_references")
    early = F.coalesce(F.col("loaded_at") < F.lit("2025-04-01").cast("timestamp"), F.lit(False))
    return st.insert_missing(rows.filter(early).select("edge_id", "votes"), rows.filter(~early).select("edge_id", "votes"), ["edge_id"])


@query(f"WITH {LATEST} SELECT book, chapter, verse, tr, row_id FROM latest WHERE tr = 'KJV' UNION ALL SELECT book, chapter, verse, tr, row_id FROM latest a WHERE tr = 'ASV' AND NOT EXISTS (SELECT 1 FROM latest b WHERE b.tr = 'KJV' AND a.book = b.book AND a.chapter = b.chapter AND a.verse = b.verse)")
def u6_overwrite(t):
    rows = _latest(t).select("book", "chapter", "verse", "tr", "row_id")
    return st.overwrite(rows.filter("tr = 'ASV'"), rows.filter("tr = 'KJV'"), ["book", "chapter", "verse"])


@query("WITH p AS (SELECT passage_id, verse_ids FROM passage_windows) SELECT a.passage_id AS a, b.passage_id AS b, round(len(list_intersect(a.verse_ids, b.verse_ids)) / greatest(len(a.verse_ids), len(b.verse_ids))::DOUBLE, 6) AS overlap FROM p a JOIN p b ON a.verse_ids[1] = b.verse_ids[1] AND a.passage_id < b.passage_id")
def u4_overlap_ratio(t):
    rows = t("passage_windows").select("passage_id", "verse_ids", F.try_element_at("verse_ids", F.lit(1)).alias("head"))
    a, b = rows.toDF("a", "ids_a", "head"), rows.toDF("b", "ids_b", "head")
    return a.join(b, "head").filter("a < b").select("a", "b", F.round(tx.jaccard_by_larger(F.col("ids_a"), F.col("ids_b")), 6).alias("overlap"))


@query("SELECT passage_id, x AS a, y AS b FROM (SELECT passage_id, verse_ids, unnest(verse_ids) AS x FROM passage_windows), unnest(verse_ids) AS u(y)")
def u7_ordered_cross(t):
    rows = t("passage_windows").select("passage_id", F.col("verse_ids").alias("a"), F.col("verse_ids").alias("b"))
    return st.ordered_cross(rows, "a", "b")


GUARDS = [(1, ["covenant"], ["DOC 1", "DOC 2"], ["river"]), (2, ["shepherd", "flock"], ["DOC 3"], []), (3, ["bread"], ["DOC 1", "DOC 4"], ["king"])]


ASKED_LABELS = "asked AS (SELECT cluster_id AS query_id, lower(cluster_label) AS text FROM tsk_clusters WHERE cluster_label IS NOT NULL), listed AS (SELECT cluster_id AS query_id, lower(cluster_label) AS text, unnest(member_verse_ids) AS item, unnest(range(len(member_verse_ids))) AS place FROM tsk_clusters)"
GUARD_SQL = f"""WITH rules(rule, keywords, items, excludes) AS (VALUES {", ".join(f"({r}, {k}, {i}, {x}::VARCHAR[])" for r, k, i, x in GUARDS)}), {ASKED_LABELS},
    hit AS (SELECT query_id, rule, items, excludes FROM asked, rules WHERE len([k FOR k IN keywords IF contains(text, k)]) > 0),
    f AS (SELECT query_id, item, min(struct_pack(r := rule, a := pos)) AS first FROM (SELECT query_id, rule, unnest(items) AS item, unnest(range(len(items))) AS pos FROM hit) GROUP BY 1, 2),
    gone AS (SELECT DISTINCT l.query_id, l.item FROM listed l JOIN (SELECT DISTINCT query_id, unnest(excludes) AS part FROM hit) USING (query_id) WHERE contains(l.text, part)),
    u AS (SELECT query_id, item, 0 AS list, row_number() OVER (PARTITION BY query_id ORDER BY first) AS ord FROM f UNION ALL SELECT query_id, item, 1, min(place) FROM listed l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = l.query_id AND f.item = l.item) AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.query_id = l.query_id AND g.item = l.item) GROUP BY 1, 2)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY list, ord, item)::INT AS place FROM u"""


@query(GUARD_SQL)
def u2_guards(t):
    rules = t.spark.createDataFrame(GUARDS, "rule int, keywords array<string>, items array<string>, excludes array<string>")
    asked = t("tsk_clusters").select(F.col("cluster_id").alias("query_id"), F.col("cluster_label").alias("text"))
    listed = t("tsk_clusters").select(F.col("cluster_id").alias("query_id"), F.posexplode("member_verse_ids").alias("place", "item"), F.col("cluster_label").alias("text"))
    return ru.guard(asked, listed, rules)


LISTS = [(1, ["covenant"], ["DOC 1", "DOC 2"], "replace"), (2, ["shepherd", "night"], ["DOC 3"], "prepend")]


@query(
    f"""WITH rules(rule, keywords, items, mode) AS (VALUES {", ".join(f"({r}, {k}, {i}, '{m}')" for r, k, i, m in LISTS)}), {ASKED_LABELS},
    hit AS (SELECT query_id, arg_min(items, rule) AS items, arg_min(mode, rule) AS mode FROM asked, rules WHERE len([k FOR k IN keywords IF contains(text, k)]) > 0 GROUP BY 1),
    f AS (SELECT query_id, unnest(items) AS item, unnest(range(len(items))) AS ord FROM hit),
    u AS (SELECT query_id, item, 0 AS list, ord FROM f UNION ALL SELECT query_id, item, 1, min(place) FROM listed l WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.query_id = l.query_id AND mode = 'replace') AND NOT EXISTS (SELECT 1 FROM f WHERE f.query_id = l.query_id AND f.item = l.item) GROUP BY 1, 2)
    SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY list, ord, item)::INT AS place FROM u"""
)
def u3_curated(t):
    rules = t.spark.createDataFrame(LISTS, "rule int, keywords array<string>, items array<string>, mode string")
    asked = t("tsk_clusters").select(F.col("cluster_id").alias("query_id"), F.col("cluster_label").alias("text"))
    listed = t("tsk_clusters").select(F.col("cluster_id").alias("query_id"), F.posexplode("member_verse_ids").alias("place", "item"))
    return ru.curated(asked, listed, rules)


# ---------------------------------------------------------------- graph


#: Components by the smallest label that reaches each node, over all edges that build clusters.
COMPONENTS = f"""{EDGES}, f AS (SELECT src, dst, votes FROM edges WHERE votes > 10 AND src <> dst), s AS (SELECT src AS a, dst AS b FROM f UNION SELECT dst, src FROM f),
    cc(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, min(cc.root) FROM cc JOIN s ON s.a = cc.node JOIN recurring.cc AS own ON own.node = s.b WHERE cc.root < own.root GROUP BY s.b)"""


def _clustered(t) -> DataFrame:
    """The edges that build clusters: all with more than ``VOTES_ABOVE`` votes."""
    return _links(t).filter(gr.votes_above(F.col("votes")) & (F.col("src") != F.col("dst"))).distinct()


@query(f"WITH RECURSIVE {COMPONENTS} SELECT node, root FROM cc")
def r2_components(t):
    return gr.components(_clustered(t), "src", "dst")


@query(
    f"""WITH RECURSIVE {COMPONENTS}, z AS (SELECT root, count(*) AS size FROM cc GROUP BY 1), v AS (SELECT root, sum(votes)::BIGINT AS vote_total FROM f JOIN cc ON src = node GROUP BY 1)
    SELECT root, size, coalesce(vote_total, 0) AS vote_total, 'general' AS label, row_number() OVER (ORDER BY size DESC, root)::INT AS number FROM z LEFT JOIN v USING (root)"""
)
def r3_roll_up(t):
    edges = cut_lineage(_clustered(t))
    return gr.roll_up(gr.components(edges, "src", "dst"), edges, "src", "votes")


@query(
    """WITH h AS (SELECT cluster_id, member_verse_ids AS m, vote_total, row_number() OVER (ORDER BY vote_total DESC NULLS LAST, cluster_id) AS rank FROM tsk_clusters QUALIFY rank <= 8),
    s AS (SELECT rank, unnest(m[1:12]) AS item, unnest(range(least(12, len(m)))) AS pos, least(1.0::DOUBLE, coalesce(vote_total, 0) / 250.0::DOUBLE) AS signal FROM h),
    b AS (SELECT item, max(signal) AS signal, min(struct_pack(r := rank, a := pos)) AS f FROM s GROUP BY 1) SELECT item, round(signal, 6) AS signal FROM b QUALIFY row_number() OVER (ORDER BY f, item) <= 5"""
)
def g12_cluster_boost(t):
    top = t("tsk_clusters").orderBy(F.col("vote_total").desc_nulls_last(), "cluster_id").limit(8)
    hits = top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("vote_total").desc_nulls_last(), "cluster_id"))).withColumn("query_id", F.lit(1))
    return gr.cluster_boost(hits, "member_verse_ids", "vote_total", "rank", "query_id").select("item", F.round("signal", 6).alias("signal"))


@query(f"WITH {EDGES}, x AS (SELECT edge_id, src, dst, votes FROM edges) SELECT edge_id, src AS source, dst AS target, votes FROM x")
def s9_cross_reference_lines(t):
    def dotted(c):
        return F.translate(F.translate(c, " ", "."), ":", ".")

    lines = _edges(t).select("edge_id", F.concat_ws("\t", dotted("src"), dotted("dst"), F.coalesce(F.col("votes").cast("string"), F.lit(""))).alias("value"))
    parsed = cross_reference_lines(lines.select("value").distinct()).distinct()
    return _edges(t).join(parsed.toDF("src", "dst", "v"), ["src", "dst"]).filter(F.col("votes").eqNullSafe(F.col("v"))).select("edge_id", F.col("src").alias("source"), F.col("dst").alias("target"), "votes")


@query("SELECT passage_id, a || ' ' || c || ':' || unnest(range(lo, hi + 1)) AS verse FROM (SELECT passage_id, split_part(passage_id, '.', 1) AS a, split_part(passage_id, '.', 2)::INT AS c, split_part(split_part(passage_id, '.', 3), '-', 1)::INT AS lo, split_part(passage_id, '.', 4)::INT AS hi FROM passage_windows)")
def f17_expand_ranges(t):
    start, end = F.split_part("passage_id", F.lit("-"), F.lit(1)), F.split_part("passage_id", F.lit("-"), F.lit(2))
    book = F.split_part("passage_id", F.lit("."), F.lit(1))
    ranges = F.concat(start, F.lit("-"), book, F.lit("."), end)
    return t("passage_windows").select("passage_id", F.explode(refs.expand_dotted(ranges)).alias("verse"))


# ---------------------------------------------------------------- citations


CITED = "regexp_extract_all(text, '\\b(?:[1-3][A-Z]{2}|[A-Z]{2,3}|[1-3]\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*|[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*)\\s+\\d+:\\d+(?:[-–]\\d+)?\\b')"


@query(f"SELECT doc_id, unnest(list_transform({CITED}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS citation FROM documents")
def f31_citations(t):
    return t("documents").select("doc_id", F.explode(ci.citations(F.col("text"))).alias("citation"))


@query(
    f"""WITH c AS (SELECT DISTINCT doc_id, primary_ref, unnest(list_transform({CITED}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS citation FROM documents)
    SELECT doc_id, citation FROM c WHERE primary_ref IS NULL OR lower(citation) <> lower(primary_ref)"""
)
def j20_invalid_citations(t):
    docs = t("documents")
    return ci.invalid_citations(docs, docs.filter("primary_ref is not null"), "doc_id", "text", "primary_ref")


@query()
def f33_scrub_citations(t):
    docs = t("documents")
    out = ci.scrub_answers(docs.select("doc_id", "text"), docs.filter("primary_ref is not null"), "doc_id", "text", "primary_ref")
    return out.select("doc_id", F.size("removed").alias("n_removed"), F.md5("text").alias("digest"))


@query(
    f"""WITH c AS (SELECT DISTINCT doc_id, unnest(list_transform({CITED}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))) AS item FROM documents), r AS (SELECT doc_id, primary_ref AS item FROM documents WHERE primary_ref IS NOT NULL),
    u AS (SELECT doc_id, count(*) AS cited FROM c JOIN r USING (doc_id, item) GROUP BY 1) SELECT doc_id, 1::BIGINT AS retrieved, coalesce(cited, 0) AS cited, round(coalesce(cited, 0)::DOUBLE, 2) AS utilisation FROM r LEFT JOIN u USING (doc_id)"""
)
def g22_utilisation(t):
    docs = t("documents")
    cited = docs.select("doc_id", F.explode(ci.citations(F.col("text"))).alias("item"))
    return ev.utilisation(cited, docs.filter("primary_ref is not null").select("doc_id", F.col("primary_ref").alias("item")), "doc_id", "item")


@query("SELECT r.event_id FROM (SELECT event_id, event_type || '-' || user_id AS item FROM events) r WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT event_type AS want FROM events WHERE event_type <> 'click') e WHERE r.item = e.want OR starts_with(r.item, e.want || '-'))")
def j14_prefix_match(t):
    rows = t("events")
    found = rows.select(F.lit(1).alias("query_id"), F.concat_ws("-", "event_type", "user_id").alias("item"), F.col("event_id").alias("rank"))
    want = rows.filter("event_type <> 'click'").select(F.lit(1).alias("query_id"), F.col("event_type").alias("item")).distinct()
    return ev.relevance(found, want).filter("hit").select(F.col("rank").alias("event_id"))


@query("SELECT unnest(['text is there', 'chapter is positive', 'known translation']) AS \"check\", unnest([count(*) FILTER (NOT coalesce(trim(text) <> '', false)), count(*) FILTER (NOT coalesce(chapter > 0, false)), count(*) FILTER (NOT coalesce(upper(trim(translation)) IN ('BSB', 'KJV', 'WEB', 'ASV', 'NHEB'), false))]) AS failed FROM verses")
def g24_integrity(t):
    known = F.upper(F.trim("translation")).isin("BSB", "KJV", "WEB", "ASV", "NHEB")
    return ev.integrity(t("verses"), {"text is there": F.trim("text") != "", "chapter is positive": F.col("chapter") > 0, "known translation": known})


# ---------------------------------------------------------------- events


EV = "ev AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events)"


@query(f"WITH {EV} SELECT user_id, a.event_id, a.ms, (SELECT count(*) FROM ev b WHERE b.user_id = a.user_id AND b.ms > a.ms - {DAY} AND (b.ms < a.ms OR (b.ms = a.ms AND b.event_id <= a.event_id))) AS count, (SELECT count(*) FROM ev b WHERE b.user_id = a.user_id AND b.ms > a.ms - {DAY} AND (b.ms < a.ms OR (b.ms = a.ms AND b.event_id <= a.event_id))) <= 5 AS allowed FROM ev a")
def x3_sliding_log(t):
    return li.sliding_log(t("events"), "user_id", "ts", "event_id", DAY, 5)


@query(
    f"""WITH {EV}, b AS (SELECT *, coalesce(ms - lag(ms) OVER w >= 14400000, true) AS s FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)), r AS (SELECT *, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ms, event_id) AS run FROM b)
    SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id, run ORDER BY ms, event_id) AS count, row_number() OVER (PARTITION BY user_id, run ORDER BY ms, event_id) <= 3 AS allowed FROM r"""
)
def x2_after_last(t):
    return li.after_last(t("events"), "user_id", "ts", "event_id", 14_400_000, 3)


@query(
    f"""WITH RECURSIVE {EV}, o AS (SELECT user_id, event_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS n FROM ev),
    r AS (SELECT user_id, event_id, ms, n, ms AS window_start, 1::BIGINT AS count FROM o WHERE n = 1 UNION ALL
    SELECT o.user_id, o.event_id, o.ms, o.n, CASE WHEN o.ms - r.window_start >= {DAY} THEN o.ms ELSE r.window_start END, CASE WHEN o.ms - r.window_start >= {DAY} THEN 1 ELSE r.count + 1 END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, event_id, ms, window_start, count, count <= 5 AS allowed, count > 4 AS warned FROM r"""
)
def x1_anchored_window(t):
    return li.anchored(t("events"), "user_id", "ts", "event_id", DAY, 5, 4)


@query("SELECT r.event_id, CASE WHEN epoch_us(r.ts) - epoch_us(w.ts) < 259200000000 THEN w.props END AS value, coalesce(epoch_us(r.ts) - epoch_us(w.ts) < 259200000000, false) AS hit FROM (SELECT * FROM events WHERE event_type <> 'purchase') r ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') w ON r.user_id = w.user_id AND r.ts >= w.ts")
def x5_cache_lookup(t):
    rows = t("events")
    reads = rows.filter("event_type <> 'purchase'").select("event_id", "user_id", "ts")
    writes = rows.filter("event_type = 'purchase'").select("user_id", "ts", F.col("props").alias("value"))
    return ca.cached_at(reads, writes, "user_id", "ts", "value", ca.RESPONSE_TTL).select("event_id", "value", "hit")


@query("SELECT event_id, trim(props) <> '' AND NOT contains(props, '7') AS keep FROM events")
def x6_cache_policy(t):
    text = F.when(F.contains("props", F.lit("7")), F.lit(ca.NOTHING_FOUND + " here")).otherwise(F.col("props"))
    return t("events").select("event_id", ca.worth_keeping(text).alias("keep"))


@query("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def x9_tumbling_metrics(t):
    out = ca.tumbling(t("events"), "ts", "1 hour", ["event_type"], "value")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"))


@query(
    """WITH b AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000, true) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), r AS (SELECT *, sum(s::INT) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM b)
    SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 21600000000 AS session_end, count(*) AS n FROM r GROUP BY user_id, run"""
)
def x2_sessions(t):
    out = ca.sessions(t("events"), "ts", "user_id", "6 hours")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


@query("SELECT 'latency' AS event, user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def k13_event_rows(t):
    from corpusmill.sources.writers import event_rows

    rows = event_rows(t("events").groupBy("user_id").agg(F.count("*").alias("n")), "latency", "user_id", "n")
    body = F.from_json("body", "user_id long, n long")
    return rows.select("event", body["user_id"].alias("user_id"), body["n"].alias("n"))


@query("SELECT user_id, event_type AS metric, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def g25_metric_sums(t):
    return t("events").groupBy("user_id", F.col("event_type").alias("metric")).agg(F.round(F.sum("value"), 4).alias("total"))
