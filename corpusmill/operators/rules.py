"""Rules as tables: topics and their synonyms, tags by keyword, guards and curated lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clamp01, dot, has_any, has_keyword_column, tokens, topic_tokens
from corpusmill.operators.sets import prepend
from corpusmill.session import cut_lineage, spread

TOPIC_LEAST, TOPICS_PER_ITEM = 0.4, 3
#: A rule table is broadcast up to this many rows; a longer one is refused, since every row meets every rule.
MOST_RULES = 20_000
#: Phrases are looked for in every text, so they are fewer.
MOST_PHRASES = 1_000
# Steps of topic detection: a strong share of words, a weak one, a similarity.
STRONG_SHARE, WEAK_SHARE, LEAST_SIMILARITY = 0.4, 0.2, 0.35


def _bounded(rules: DataFrame) -> DataFrame:
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return F.broadcast(rules)


def tag_rows(rows: DataFrame, rules: DataFrame, item: str, text: str, most: int = TOPICS_PER_ITEM, least: float = TOPIC_LEAST) -> DataFrame:
    """(item, topic_id, confidence, place): the best topics of each row.

    ``rules`` has (topic_id, keyword, confidence). A topic's confidence is that of its best matching keyword, limited to
    0..1; topics below ``least`` are dropped; ties are ordered by topic. Keywords of one word are met by an equi-join
    with the distinct words of each text; only phrases, at most ``MOST_PHRASES``, are looked for in every text.
    """
    known = _bounded(rules.select("topic_id", F.lower("keyword").alias("keyword"), clamp01(F.col("confidence")).alias("confidence")).filter(F.col("confidence") >= least))
    single = F.rlike("keyword", F.lit(r"^\w+$"))
    texts = spread(rows).select(F.col(item).alias("item"), F.col(text).alias("text_"))
    words = texts.select("item", F.explode(F.array_distinct(tokens(F.col("text_")))).alias("keyword"))
    met = words.join(known.filter(single), "keyword").select("item", "topic_id", "confidence")
    phrases = known.filter(~single)
    many = phrases.limit(MOST_PHRASES + 1).count()
    if many > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    if many:
        found = texts.join(F.broadcast(phrases), has_keyword_column(F.col("text_"), F.col("keyword")))  # counted above
        met = met.unionByName(found.select("item", "topic_id", "confidence"))
    best = met.groupBy("item", "topic_id").agg(F.max("confidence").alias("confidence"))
    by = Window.partitionBy("item").orderBy(F.col("confidence").desc(), F.col("topic_id"))
    return best.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).withColumnRenamed("item", item)


def items_of_topics(tags: DataFrame, item: str) -> DataFrame:
    """(topic_id, item): the items of each topic, each once; a topic of any size is never gathered into one row."""
    return tags.select("topic_id", item).distinct()


def tag_array(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """The tags whose keywords match, in rule order."""
    return F.array_compact(F.array(*[F.when(has_any(text, keywords), tag) for tag, keywords in rules]))


def clean_topics(topics: DataFrame) -> DataFrame:
    """Topic ids and synonyms lower-cased and trimmed, topics without an id dropped, each id once."""
    rows = topics.withColumn("topic_id", F.lower(F.trim("topic_id"))).filter(F.length("topic_id") > 0)
    return rows.withColumn("synonyms", F.transform("synonyms", lambda s: F.lower(F.trim(s)))).dropDuplicates(["topic_id"])


def clean_assignments(assigned: DataFrame, item: str) -> DataFrame:
    """(item, topic_id, confidence): confidences limited to 0..1, those of 0 dropped, the highest per pair."""
    rows = assigned.select(item, F.lower(F.trim("topic_id")).alias("topic_id"), clamp01(F.col("confidence")).alias("confidence"))
    return rows.filter("confidence > 0").groupBy(item, "topic_id").agg(F.max("confidence").alias("confidence"))


def detect_topics(questions: DataFrame, topics: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, topic_id, score): topics by shared words, strong ones first, weak ones only without strong ones.

    ``questions`` has (query_id, text) and may have query_vector; ``topics`` has (topic_id, words) and may have
    topic_vector, used where no topic shares enough words. A topic's score is the share of its words in the question.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(topic_tokens(F.col("text")))).alias("word")).distinct()
    sized = topics.select("topic_id", F.array_distinct("words").alias("words"))
    words = _bounded(sized.select("topic_id", F.size("words").alias("size"), F.explode("words").alias("word")))
    shared = asked.join(words, "word").groupBy("query_id", "topic_id").agg((F.count("*") / F.first("size")).alias("score"))
    best = F.max("score").over(Window.partitionBy("query_id"))
    kept = shared.withColumn("best", best).filter((F.col("best") >= WEAK_SHARE) & ((F.col("best") < STRONG_SHARE) | (F.col("score") >= STRONG_SHARE))).select("query_id", "topic_id", "score")
    if "query_vector" in questions.columns and "topic_vector" in topics.columns:
        rest = questions.join(kept.select("query_id"), "query_id", "left_anti").select("query_id", "query_vector")
        close = rest.join(_bounded(topics.select("topic_id", "topic_vector")), F.size("query_vector") == F.size("topic_vector"))
        close = close.select("query_id", "topic_id", dot(F.col("query_vector"), F.col("topic_vector")).alias("score"))
        kept = kept.unionByName(close.filter(F.col("score") >= LEAST_SIMILARITY))
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("topic_id"))
    return kept.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= most).select("query_id", "topic_id", "score", "place")


def rules_hit(questions: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, the rule's columns...): the rules of which a question (query_id, text) contains any keyword."""
    return questions.select("query_id", F.lower("text").alias("asked")).join(_bounded(rules), F.exists("keywords", lambda k: F.contains(F.col("asked"), F.lower(k)))).drop("asked")


def guard(questions: DataFrame, retrieved: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, item, place): retrieved lists with the priority items of matching rules first and excluded texts gone.

    ``questions`` has (query_id, text); ``retrieved`` has (query_id, item, place, text); ``rules`` has (keywords,
    items, excludes): a rule matches a question that contains any keyword; its items come first in rule order (``rule``)
    and rows whose text contains any of its excludes are dropped, unless they are priority items.
    """
    hit = cut_lineage(rules_hit(questions, rules))  # a row for each rule that a question meets, read three times
    first = hit.select("query_id", "rule", F.posexplode("items").alias("at", "item")).groupBy("query_id", "item").agg(F.min(F.struct("rule", "at")).alias("first_"))
    first = first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("first_"))).drop("first_")
    parts = hit.select("query_id", F.explode("excludes").alias("part")).distinct()
    gone = retrieved.join(parts, "query_id").filter(F.contains(F.lower("text"), F.lower("part"))).select("query_id", "item").distinct()
    return prepend(first, retrieved, "query_id", "item", "place", gone)


def curated(questions: DataFrame, retrieved: DataFrame, rules: DataFrame) -> DataFrame:
    """(query_id, item, place): the first matching rule's list in front of a retrieved one, or in its place.

    ``rules`` has (rule, keywords, items, mode) with mode ``replace`` or ``prepend``.
    """
    hit = rules_hit(questions, rules)
    chosen = hit.groupBy("query_id").agg(F.min_by(F.struct("items", "mode"), "rule").alias("list"))
    chosen = cut_lineage(chosen)  # at most a row for each question, read three times
    first = chosen.select("query_id", F.posexplode("list.items").alias("place", "item"))
    kept = retrieved.join(chosen.filter("list.mode = 'replace'"), "query_id", "left_anti")
    return prepend(first, kept, "query_id", "item", "place")
